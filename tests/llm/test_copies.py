"""SimHash, components, and the pipeline."""

import re
import random

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from facejobs.llm import common, graph, packing, quality_rules, simhash


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints(spark, hard):
    got = simhash.fingerprints(hard).collect()
    assert [r[common.RESULT] % 2**64 for r in got] == [fingerprint(r.text) for r in got]


@pytest.mark.parametrize("shape", ["none", "path", "star", "random", "loops"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {"none": [], "path": [(k, k + 1) for k in range(40)], "star": [(99, k) for k in range(40)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], "loops": [(1, 1), (2, 1), (1, 2), (2, 1)]}[shape]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame([*edges, (None, 1)], "u long, v long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == roots(nodes, edges)


@pytest.mark.parametrize("crowd", [2, 256])
@pytest.mark.parametrize("segments", [2, 4])
def test_links_equal_all_pairs(spark, crowd, segments):
    rng = np.random.default_rng(4)
    values = set()
    for _ in range(12):
        base = int(rng.integers(0, 2**63))
        for _ in range(15):
            v = base
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                v ^= 1 << int(b)
            values.add(int(np.uint64(v).astype(np.int64)) if v < 2**63 else v - 2**64)
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "fp long").repartition(3)
    got = {(r.u, r.v) for r in simhash.links(df, segments=segments, crowd=crowd).collect()}
    assert got == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin((a ^ b) % 2**64).count("1") <= 3}


def test_hard_rows(spark, hard):
    got = simhash.components(hard).collect()
    assert len(got) == hard.count()
    empty = {r.component_id for r in got if r.fp == 0}
    assert empty == {0}
    kept = simhash.keep_one(hard)
    assert kept.columns == hard.columns
    fps = [fingerprint(r.text) for r in kept.collect()]
    assert len(fps) == len(set(fps)) == len({r.component_id if r.component_id is not None else r.fp for r in got})
    assert simhash.components(hard.limit(0)).count() == simhash.keep_one(hard.limit(0)).count() == 0


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(6)
    syllables = ["ba", "re", "ti", "on", "ka", "lu", "mi", "so"]
    sentence = lambda n: " ".join(rng.choice(["the", "of"]) if rng.random() < 0.2 else "".join(rng.choices(syllables, k=3)) for _ in range(n))
    texts = [sentence(60) for _ in range(40)]
    texts += [texts[3], texts[3].upper(), "few words", "", None]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = common.stage(out, "test")
    want = [k for k in range(40)]
    assert sorted(r.doc_id for r in docs.collect()) == want
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == want and {r.piece for r in got} == {0}
    n = -(-sum(r.length for r in got) // packing.CAPACITY)
    assert len({r.sequence_id for r in got}) <= n + 1
    assert corpus_pipeline.ORACLE_SQL is None and quality_rules.keep(docs).count() == len(want)
