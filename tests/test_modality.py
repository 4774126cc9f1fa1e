"""The two modality indicators of a level's values, against all pairs, drawn nulls and SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from levelscan.functions.special import DIP_QUANTILES, DIP_SHARES, dip_sf, dip_sf_sql
from levelscan.operators import indicators as I
from levelscan.operators.aggregates import level_table


def all_pairs(x):
    """Best split by squared error, then the silhouette of every row from its distances to all others."""
    x = np.sort(np.asarray(x, float))
    cuts = [i for i in range(1, len(x)) if x[i] > x[i - 1]]
    if not cuts:
        return 0.0
    cut = min(cuts, key=lambda i: (round(x[:i].var() * i + x[i:].var() * (len(x) - i), 9), i))
    total = 0.0
    for i in range(len(x)):
        own, other = (x[:cut], x[cut:]) if i < cut else (x[cut:], x[:cut])
        if len(own) > 1:
            a, b = abs(own - x[i]).sum() / (len(own) - 1), abs(other - x[i]).mean()
            total += (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return total / len(x)


def samples():
    rng = np.random.default_rng(4)
    out = [[1.0], [2.0, 2.0, 2.0], [0.0, 1.0], [0.0, 0.0, 5.0], [1e9, 1e9 + 1, 1e9 + 2, 1e9 + 9]]
    return out + [np.round(rng.normal(0, 1, n) + rng.choice([0, 5], n), d).tolist() for n in (5, 12, 40, 90) for d in (0, 1, 6)]


def test_split_silhouette():
    for x in samples():
        v, c = np.unique(x, return_counts=True)
        assert I.split_silhouette(v, c) == pytest.approx(all_pairs(x), abs=1e-9)


@pytest.mark.parametrize("limit", [500_000, 8])
def test_modality_of_groups_of_any_size(spark, limit):
    rows = [(f"g{i}", x) for i, s in enumerate(samples()) for x in s] + [("g1", None), ("none", None)]
    got = {r["g"]: r for r in I.modality(spark.createDataFrame(rows, "g string, x double").repartition(4), ["g"], "x", limit).collect()}
    assert set(got) == {f"g{i}" for i in range(len(samples()))}
    for i, s in enumerate(samples()):
        v, c = np.unique(s, return_counts=True)
        assert got[f"g{i}"]["silhouette_k2"] == pytest.approx(all_pairs(s), abs=1e-9)
        assert got[f"g{i}"]["dip_statistic"] == pytest.approx(I.dip_of(v, c) if len(s) >= 4 else 0.0, abs=1e-12)


def test_dip_tail(spark):
    cases = [(t / n**0.5, n) for n in (1, 3, 4, 5, 7, 10, 49, 50, 51, 1000, 10**12) for t in np.arange(0.1, 0.9, 0.013)]
    df = spark.createDataFrame([(i, float(d), n) for i, (d, n) in enumerate(cases)], "i int, d double, n bigint")
    got = {r["i"]: r["p"] for r in df.select("i", dip_sf(F.col("d"), F.col("n")).alias("p")).collect()}
    con = duckdb.connect()
    con.register("t", df.toPandas())
    assert got == {i: pytest.approx(p, rel=1e-9) for i, p in con.execute(f"SELECT i, {dip_sf_sql('d', 'n')} FROM t").fetchall()}
    for n in {n for _, n in cases}:
        p = [got[i] for i, c in enumerate(cases) if c[1] == n]
        assert p == sorted(p, reverse=True) and (set(p) == {1.0} if n < 4 else p[0] == 1.0 and 0 < p[-1] < 1e-4)
    limit = spark.range(1).select(*[dip_sf(F.lit(q) / 1e8, F.lit(10**16)).alias(f"p{i}") for i, q in enumerate(DIP_QUANTILES[-1])]).first()
    assert list(limit) == pytest.approx(list(DIP_SHARES), rel=1e-3)


@pytest.mark.parametrize("n", [9, 24, 150])
def test_dip_tail_of_uniform_samples(spark, n):
    rng = np.random.default_rng(n)
    df = spark.createDataFrame([(I.dip_of(np.sort(rng.random(n)), np.ones(n)), n) for _ in range(800)], "d double, n bigint")
    p = np.array([r[0] for r in df.select(dip_sf(F.col("d"), F.col("n"))).collect()])
    for share in (0.05, 0.1, 0.3, 0.5, 0.7):
        assert (p <= share).mean() == pytest.approx(share, abs=4.5 * (share * (1 - share) / 800) ** 0.5)


def test_level_table(spark):
    rng = np.random.default_rng(1)
    rows = [("t", "m", 0, float(x), True, "a") for x in rng.normal(0, 1, 300)] + [("t", "m", 1, float(x), False, "b") for x in np.r_[rng.normal(0, 1, 150), rng.normal(12, 1, 150)]]
    one, two = level_table(spark.createDataFrame(rows, "task string, model string, level int, x double, correct boolean, answer string")).orderBy("level").collect()
    assert one["dip_pvalue"] > 0.05 > 1e-3 > two["dip_pvalue"] and two["silhouette_k2"] > 0.8 > one["silhouette_k2"] > 0.4
