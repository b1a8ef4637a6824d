"""Near copies of the pipeline by brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from facejobs.llm import common, near_copies


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {k for k in up if find(k) == k}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices(["ba", "re", "ti", "on", "ka", "lu"], k=3))
    line = [word() for _ in range(30)]
    found = ["", None, "one two", "one two"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([8, 40, 120, 300]))] + line * rng.randrange(2)
        for _ in range(5):  # copies of copies, so that groups are chains as well as stars
            found.append(" ".join(base))
            for _ in range(rng.randrange(1, 2 + len(base) // 30)):
                base[rng.randrange(len(base))] = word()
    rng.shuffle(found)
    return found


def test_stage_keeps_one_of_all_similar(spark, texts, tmp_path):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = kept(texts)
    assert 30 < len(want) < len(texts) - 30
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path)).collect()} == want


def test_order_of_shingles_does_not_matter(spark, texts, monkeypatch):
    monkeypatch.setattr(near_copies, "FREQUENT", 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == kept(texts)


def test_parity_maps_rule_out_no_similar_pair(spark):
    rng = np.random.default_rng(4)
    rows, similar = [], []
    for n in (1, 5, 9, 60, 300, 1000, 4000):
        for changed in (0, n // 10, n // 9, n // 5, n):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)])
            similar.append(9 * (n - changed) >= 8 * n)
            rows.append((len(rows), (n, near_copies.parity(a).tolist()), (n, near_copies.parity(b).tolist())))
    side = "struct<n:int,map:array<long>>"
    found = spark.createDataFrame(rows, f"k int, a {side}, b {side}").select("k", near_copies._maps_allow("a", "b").alias("ok")).where(F.col("ok")).collect()
    allowed = {r.k for r in found}
    assert {k for k, x in enumerate(similar) if x} <= allowed
    unlike = {k for k, (_, a, b) in enumerate(rows) if a[0] == 300 and k % 5 == 4}
    assert unlike and not unlike & allowed


def test_hard_rows(spark, hard):
    out = near_copies.keep_one(hard)
    assert out.columns == hard.columns
    assert [len(shingles(r.text)) for r in out.collect()].count(0) == 1
    assert near_copies.keep_one(hard.limit(0)).count() == 0
    assert common.RESULT not in "".join(out.columns)
