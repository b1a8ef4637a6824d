import random
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from facejobs.llm import bond

SCHEMA = "vec_id long, embedding array<double>, label int, negative_id string, place int, vector string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def brute(rows):
    """Every score, in whole numbers."""
    held = []
    for v, x, y in rows:
        if v is None or y is None or x is None or any(e is None or not np.isfinite(e) for e in x):
            continue
        held.append((v, (y + 1) % 10 if v % 7 == 0 else y, x, [floor(Fraction(e) * 256) for e in x]))
    anchors = {}
    for v, y, x, w in held:
        if v % 50 == 0 and (v not in anchors or (y, x) < anchors[v][:2]):
            anchors[v] = (y, x, w)
    out = []
    for a, (label, _, q) in anchors.items():
        score = lambda w: sum(p * r for p, r in zip(q, w))  # noqa: E731, B023
        scored = [(-score(w), v, y) for v, y, _, w in held if len(w) == len(q)]
        near = sorted(s for s in scored if s[2] == label and s[1] != a)[:5]
        for ps, p, _ in near:
            inside = sorted(s for s in scored if s[2] != label and 50 * -ps <= 100 * -s[0] <= 95 * -ps)[:3]
            out += [(a, p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(inside, 1)]
    return sorted(out)


def found(spark, rows):
    got = bond.hard_negatives(table(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def test_equals_all_scores(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 0.3) + 0.3 * (d == k % 4) for d in range(12)], k % 4) for k in range(400)]
    got = found(spark, rows)
    assert got == brute(rows) and len(got) > 60


def test_nulls_ties_repeats_lengths_and_large_numbers(spark):
    rng = random.Random(4)
    same = [0.5, 0.25, -0.125]
    rows = [(k, list(same), k % 2) for k in range(0, 120)]  # ties everywhere
    rows += [(k, [0.25, 0.25, -0.1], k % 3) for k in range(120, 160)]
    rows += [(50, list(same), 0), (51, list(same), 1), (51, list(same), 1), (100, [0.1, 0.0, 0.0], 0)]  # repeated ids, another vector of an anchor
    rows += [(None, list(same), 1), (200, None, 1), (201, list(same), None), (202, [0.5, None, 0.0], 1), (203, [float("nan"), 0.0, 0.0], 1), (204, [float("inf"), 0.0, 0.0], 0)]
    rows += [(250, [1.0, 2.0], 3), (251, [1.0, 1.0], 3), (252, [0.5, 1.0], 4), (300, [], 5), (301, [], 5), (302, [], 6)]
    rows += [(350 + k, [rng.uniform(-1, 1) * 1e6 for _ in range(4)], k % 2) for k in range(40)]
    assert found(spark, rows) == brute(rows)


def test_scores_past_doubles_and_past_longs(spark):
    rows = [(k, [float(2**28 + k), float(2**27 - k), 3.0 * k, 1.0, 5.0], k % 2) for k in range(20)]  # sums over 2**53
    assert found(spark, rows) == brute(rows)
    huge = [(k, [1e300, -1e200, 1.0], k % 2) for k in range(6)]
    assert found(spark, huge) == []  # clipped scores are equal and lie in no window; nothing fails
    clipped = [(0, [1e300], 1), (2, [1e10], 1), (3, [-8e9], 2), (50, [3.0], 1), (51, [2.0], 1), (52, [1.5], 2)]
    assert [r for r in found(spark, clipped) if r[0] == 50 and r[1] == 51] == [r for r in brute(clipped) if r[0] == 50 and r[1] == 51] != []


def test_empty_and_without_anchors(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_pruning_is_exact_and_prunes():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(0, 0.2, (64, 3000)))
    x[:, :30] += 40  # a near cluster
    block = bond.Block(np.arange(3000), np.zeros(3000, np.int64), x)
    anchor = np.floor(256 * rng.normal(0, 0.2, 64)) + 40
    left = []
    prune = lambda low, high: left.append(len(low)) or high >= bond._kth(low, 5)
    places, scores = block.scan(anchor, np.ones(3000, bool), prune)
    want = anchor @ x
    assert (scores == want[places]).all()
    assert set(np.argsort(-want, kind="stable")[:5]) <= set(places) and len(places) < 300 and left[0] == 3000


@pytest.mark.parametrize("score", [-7, -1, 0, 1, 3, 10, 99, 101, 12345])
def test_windows(score):
    low, high = bond.window_of(score)
    inside = [s for s in range(-20, 12400) if 50 * score <= 100 * s <= 95 * score]
    assert inside == list(range(low, high + 1))
