"""Exact rank-sum tails against listed samples, the recurrence over sample sizes, and their own limits."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F  # noqa: F401

from levelscan.operators import statistics as T


def listed(m, n):
    """P(U >= u) for every u, from all ways to pick the ranks of the smaller sample."""
    counts = np.zeros(m * n + 1)
    for ranks in itertools.combinations(range(m + n), m):
        counts[sum(ranks) - m * (m - 1) // 2] += 1
    return np.cumsum(counts[::-1])[::-1] / math.comb(m + n, m)


@pytest.mark.parametrize("m, n", [(1, 1), (2, 2), (2, 9), (3, 7), (4, 4), (5, 8), (8, 8)])
def test_against_all_samples(m, n):
    want = listed(m, n)
    assert [T.rank_sum_tail(m, n, u) for u in range(m * n + 1)] == pytest.approx(want.tolist(), rel=1e-12)
    assert T.rank_sum_tail(m, n, m * n + 1) == 0 and T.rank_sum_tail(m, n, -1) == 1


def test_three_against_forty_five_and_more():
    def recurrence(m, n, memo={}):  # paths that end in either sample
        if (m, n) not in memo:
            memo[m, n] = [1] if not m or not n else [(recurrence(m - 1, n)[u - n] if 0 <= u - n < len(recurrence(m - 1, n)) else 0) + (recurrence(m, n - 1)[u] if u < len(recurrence(m, n - 1)) else 0) for u in range(m * n + 1)]
        return memo[m, n]

    counts = recurrence(3, 45)
    for u in (0, 1, 30, 67, 68, 100, 134, 135):
        assert T.rank_sum_tail(3, 45, u) == pytest.approx(sum(counts[u:]) / math.comb(48, 3), rel=1e-12)
    for n in (100_000, 10_000_000):  # counted, and in the limit of many
        assert T.rank_sum_tail(8, n, round(5.5 * n)) == pytest.approx(T.rank_sum_tail(8, 50_000, round(5.5 * 50_000)), rel=2e-3)


def test_mann_whitney_is_exact_for_any_larger_side(spark):
    rng = np.random.default_rng(3)
    a, b = rng.permutation(10_000)[:4].tolist(), [x + 0.5 for x in rng.permutation(10_000)[:400].tolist()]
    df = spark.createDataFrame([("g", float(x), "a") for x in a] + [("g", float(x), "b") for x in b] + [("t", 1.0, "a"), ("t", 1.0, "b"), ("t", 2.0, "a"), ("t", 3.0, "b")], "g string, v double, s string")
    got = {r["g"]: r for r in T.mann_whitney(df, ["g"], "v", "s", "a", "b").collect()}
    u = sum(x > y for x in a for y in b)
    assert got["g"]["u"] == u and got["g"]["p_greater"] == pytest.approx(T.rank_sum_tail(4, 400, u), rel=1e-12)
    assert 0 < got["t"]["p_greater"] < 1  # tied: the normal form
