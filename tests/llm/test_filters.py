"""Quality rules, licences, toxicity, quality classifier."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from facejobs.llm import common, labelled, licences, quality_fm, quality_rules, toxicity


def measured(text):
    """The base counts by brute force."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def test_rules_equal_brute_force(spark, hard):
    got = quality_rules.judge(hard).select("text", f"{common.RESULT}.*").collect()
    assert len(got) == hard.count()
    for r in got:
        want = measured(r.text)
        assert (r["n_words"] if not isinstance(r["n_words"], list) else 0, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        base = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == base and not (base and r.kept)


def test_rules_on_random_texts(spark):
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.choice(list("abcd"), rng.integers(0, 60))) + "\n" * int(rng.integers(0, 3))) for k in range(200)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).select("text", f"{common.RESULT}.*").collect()
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(r.text) for r in got)


def test_keep_leaves_columns_alone(spark, hard):
    kept = quality_rules.keep(hard)
    assert kept.columns == hard.columns and kept.where("doc_id IS NULL").count() == 0
    assert quality_rules.keep(hard.limit(0)).count() == 0


def phrases(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, x) for p, x in licences.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_licences(spark, hard):
    more = ["GNU  General-Public License x cc by y MIT license mit License", "this work is licensed under the gnu general public license version 3", "gnu general public", "cc_by apache\nlicense"]
    docs = hard.select("doc_id", "text").unionAll(spark.createDataFrame([(100 + k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    got = licences.scan(docs).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id != 3}
    for r in got:
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        if r.doc_id in texts:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == phrases(texts[r.doc_id])
    by = {r.doc_id: r for r in got}
    assert by[101].labels == "gpl,gpl-3" and by[101].score == 1 and by[102].labels == "" and by[103].labels == "apache,cc-by"
    assert licences.scan(docs.limit(0)).count() == 0


def corpus(spark, n=400):
    rng = np.random.default_rng(1)
    syllables = ["ba", "re", "ti", "on", "ka", "lu", "mi", "so", "ne", "da"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    rows, marks = [], []
    for k in range(n):
        toxic, junk = k % 4 == 0, k % 5 == 0
        words = [word() for _ in range(int(rng.integers(30, 120)))]
        for _ in range(4 * toxic):
            words[int(rng.integers(len(words)))] = "vile" + rng.choice(syllables)
        text = " ".join(w.upper() + "!!" if junk else w for w in words)
        rows.append((k, text, len(text)))
        marks.append((k, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "modulus", "held", "least"), [(toxicity, "toxic", 3, 1, 0.85), (quality_fm, "quality", 5, 0, 0.95)])
def test_classifiers_on_held_out_rows(spark, module, label, modulus, held, least):
    docs, marks = corpus(spark)
    model = module.learn(docs, marks)
    rows = module.score(docs, model).join(marks, "doc_id").collect()
    apart = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % modulus == held]
    assert len(apart) > 50 and all(0 <= r[common.RESULT] <= 1 for r in rows)
    assert np.mean([(r[common.RESULT] >= module.THRESHOLD) == r[label] for r in apart]) >= least


@pytest.mark.parametrize("module", [toxicity, quality_fm])
def test_classifiers_take_hard_rows(spark, hard, labels, module):
    model = module.learn(hard, labels)
    got = module.score(hard, model).collect()
    assert len(got) == hard.count() and all(0 <= r[common.RESULT] <= 1 for r in got)
    assert module.score(hard.limit(0), model).count() == 0
    none = module.learn(hard, labels.limit(0))
    assert none is None and {r[common.RESULT] for r in module.score(hard, none).collect()} == {0.0}


def test_gains_are_differences_of_compressed_lengths(spark):
    docs, marks = corpus(spark, 200)
    model = toxicity.learn(docs, marks)
    assert model.toxic.endswith(model.ordinary) and b"vile" in model.toxic[: -len(model.ordinary)]

    def length(data, dictionary):
        params = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=3, strategy=zstandard.STRATEGY_BTLAZY2, window_log=17)
        held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out = zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress(data)
        assert zstandard.ZstdDecompressor(dict_data=held).decompress(out, max_output_size=len(data)) == data
        return len(out)

    carrier = model.ordinary[-toxicity.CARRIER :]
    for text in ["", "one", "vileba re ti", *(r.text for r in docs.limit(20).collect())]:
        words = text.lower().encode().split()
        cut = [b" " + b" ".join(words[k : k + toxicity.WINDOW]) + b" " for k in range(0, len(words), toxicity.WINDOW)]
        want = [length(carrier + w, model.ordinary) - length(carrier + w, model.toxic) for w in cut] or [0]
        assert toxicity.gains(text, model.ordinary, model.toxic).tolist() == want


def test_typical_sequences_by_brute_force():
    toxic = [b" you vile one and two ", b" you vile one and two ", b" a vile three ", b" some vile four ", b" six vile five "]
    ordinary = [b" you one and two ", b" a three or four ", b" some five six "]
    places = lambda texts: {(t[i - 6 : i] if i >= 6 else None, t[i : i + 6], t[i + 6 : i + 12] if i + 12 <= len(t) else None) for t in texts for i in range(len(t) - 5)}
    count = lambda texts: Counter(g for _, g, _ in places(texts))
    grams, n = toxicity._contexts(toxic)
    assert {int(g).to_bytes(6, "big"): int(k) for g, k in zip(grams, n)} == count(toxic)
    typical = {int(g).to_bytes(6, "big") for g in toxicity._typical(toxic * 3, ordinary)}
    assert typical <= {b" vile ", b"e vile"} and toxicity.spans([b" x vile y "], np.array([int.from_bytes(b" vile ", "big")], np.uint64)) == [b" vile "]


def test_the_order_of_rows_is_of_no_account(spark):
    docs, marks = corpus(spark, 200)
    sample = labelled.sample(docs, marks, "toxic", 3, 1, toxicity.SAMPLE)
    back = labelled.Sample(sample.texts[::-1], sample.y[::-1], sample.weight, sample.more[::-1])
    assert toxicity.fit(sample) == toxicity.fit(back)


def test_held_out_rows_teach_nothing(spark):
    docs, marks = corpus(spark, 60)
    sample = labelled.sample(docs, marks, "toxic", 3, 1, {0: 100, 1: 100})
    texts = {r.text: r.doc_id for r in docs.collect()}
    assert sample.texts and all(zlib.crc32(str(texts[t]).encode()) % 3 != 1 for t in sample.texts)
    flipped = marks.withColumn("toxic", F.when(labelled.remainder("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert labelled.sample(docs, flipped, "toxic", 3, 1, {0: 100, 1: 100}) == sample


def test_machine_in_linear_time_equals_all_pairs():
    rng = np.random.default_rng(2)
    m = quality_fm.Model(0.3, rng.normal(size=12), rng.normal(size=(12, 4)), np.zeros(2), np.ones(2), 1.0, 0.0)
    index, value = np.array([1, 4, 10, 11]), np.array([0.5, 0.2, 1.5, -0.7])
    pairs = sum(m.factors[index[a]] @ m.factors[index[b]] * value[a] * value[b] for a in range(4) for b in range(a))
    assert m.logit(index, value) == pytest.approx(0.3 + m.linear[index] @ value + pairs)
