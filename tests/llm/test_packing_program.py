"""The configuration program on histograms without exactly full sequences, where best fit is far from the bound."""

from collections import Counter

import numpy as np
import pytest

from facejobs.llm import packing


def count(plan):
    return sum(times for _, times in plan.fillings)


@pytest.mark.parametrize(("low", "high"), [(900, 1500), (1300, 2100)])
def test_the_weights_save_sequences(low, high):
    histogram = Counter(np.random.default_rng(1).integers(low, high, 2000).tolist())
    plan, flat, once = (packing.solve(dict(histogram), **how) for how in ({}, {"rate": 0.0}, {"rounds": 1}))
    alone = sum(times for _, times in packing._best_fit(dict(histogram), packing.CAPACITY))
    print(f"{low}-{high}: {count(plan)} sequences, best fit {alone}, bound {plan.bound}, fractional {plan.primal:.1f}")
    assert count(plan) < min(count(flat), count(once)) and max(count(flat), count(once)) <= alone
    assert plan.bought >= 0.9 and plan.bound <= plan.primal and plan.bound <= count(plan)
    held = Counter()
    for filling, times in plan.fillings:
        assert sum(length * copies for length, copies in filling) <= packing.CAPACITY
        for length, copies in filling:
            held[length] += copies * times
    assert held == histogram


def test_the_dual_bounds_and_the_primal_covers():
    lengths, need = np.array([1000, 1400, 1800]), np.array([300, 200, 100])
    found = packing.fractional(lengths, need, 4096, rounds=400)
    assert found.dual <= found.primal <= (1 + packing.SLACK) * found.dual
    best = packing.knapsack(lengths, found.prices, 4096)[-1]
    assert best <= 1 + 1e-9 and abs(need @ found.prices - found.dual) < 1e-6
    for filling in found.used:
        assert sum(int(lengths[k]) * copies for k, copies in filling) <= 4096
