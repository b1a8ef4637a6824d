import random
import re
from collections import Counter
from itertools import permutations

import numpy as np

from facejobs.llm import audit


def failed(text, first, doc_id):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 100 else ""
    out += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
    out += "D" if re.search(r"[#$%&*|]", text) else ""
    return out + ("E" if doc_id is not None and first is not None and doc_id > first else "")


def brute(rows, labels):
    """rows: (doc_id, text, part); each document walks through every order."""
    first, good, toxic = {}, {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    docs = [(p or "", failed(t or "", first.get(t or ""), d), d in good and d is not None, d in toxic and d is not None) for d, t, p in rows]
    out = {}
    for part in {d[0] for d in docs}:
        mine, total = [d for d in docs if d[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                fails = [d for d in mine if x in d[1]]
                out[part, "".join(order), k] = [len(left), len(gone), len(fails) - len(gone), sum(d[1] == x for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                total[x] += len(gone)
        for (p, order, k), row in out.items():
            if p == part:
                row.append(total[order[k - 1]])
    return out


def check(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, mask int, part string, docs int")
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in audit.audit(docs, labels).collect()}
    want = brute(rows, [tuple(r) for r in labels.collect()])
    assert got == want
    return got


def test_equals_walking_through_every_order(spark, labels):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(150)]
    texts = ["", " ", "same text", "SHOUT NOW", "a # b"]
    for _ in range(60):
        n = rng.choice([5, 99, 100, 130])
        few = rng.random() < 0.4
        t = " ".join(rng.choice(words[:40]) for _ in range(n)) if few else "\t".join(rng.sample(words, n))
        t = t.upper() if rng.random() < 0.3 else t
        texts.append(t + (" |" if rng.random() < 0.3 else ""))
    rows = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(300)]
    rows += [rows[0], rows[0], (None, "same text", "en"), (None, None, None), (7, None, "fr"), (2, "other text of the id", "en"), (5, "éÉ x " * 120, "en")]
    got = check(spark, rows, labels)
    assert len(got) == 600 * 4 and any(v[1] for v in got.values())


def test_empty_and_without_labels(spark, labels, hard):
    assert audit.audit(hard.limit(0), labels).count() == 0
    rows = audit.audit(hard).collect()
    assert {r.good_lost for r in rows} == {r.toxic_lost for r in rows} == {0} and len(rows) == 600 * len({r.part for r in rows})


def test_potential_gives_the_shapley_value():
    rng = np.random.default_rng(1)
    per_mask = rng.integers(0, 50, 32)
    v = audit.worth(per_mask)
    assert v[0] == 0 and v[31] == per_mask[1:].sum() and v[1] == per_mask[1::2].sum()
    p = audit.potentials(v)
    for k in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(k)])
            total += v[before | 1 << k] - v[before]
        assert p[31] - p[31 ^ 1 << k] == total
    assert sum(p[31] - p[31 ^ 1 << k] for k in range(5)) == 120 * v[31]
