"""EWMA as a scan against its recursion, and bootstrap weights against their draws."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelscan.operators import alarms as A
from levelscan.operators import resampling as B


@pytest.mark.parametrize("chunk", [4, 64])
def test_ewma_equals_the_recursion(spark, chunk):
    rng = np.random.default_rng(2)
    rows = [("t", m, i, None if m == "gaps" and i % 3 == 1 else float(rng.normal(5, 2) + (50 if i > 150 else 0))) for m, n in (("long", 300), ("gaps", 150), ("short", 4), ("exact", 3 + 8)) for i in range(n)]
    df = A.calibrate(spark.createDataFrame(rows, "task string, model string, level int, v double"), ["v"])
    for lam in (0.05, 0.3, 0.95):
        got = A._ewma_stat(df, "v", lam, ["task", "model"], 3, "z", chunk)
        assert set(got.columns) == {*df.columns, "z"}
        by = {}
        for r in sorted(got.collect(), key=lambda r: r["level"]):
            by.setdefault(r["model"], []).append(r)
        for series in by.values():
            z = series[0]["_mu_v"]
            for r in series:
                if r["_rn"] > 3 and r["v"] is not None:
                    z = lam * r["v"] + (1 - lam) * z
                assert r["z"] == pytest.approx(z, rel=1e-12)


def test_weights_are_poisson():
    keys = np.arange(400, dtype=np.int64) * 7919 + 3
    w = B.poisson_weights(keys, 1000)
    assert (w == B.poisson_weights(keys, 2000)[:, :1000]).all()  # more replicates leave the first ones as they are
    for k in range(4):
        p = math.exp(-1) / math.factorial(k)
        assert (w == k).mean() == pytest.approx(p, abs=5 * math.sqrt(p / w.size))
    assert abs(np.corrcoef(w[:20])[np.triu_indices(20, 1)]).max() < 0.15 and abs(np.corrcoef(w[:, :20].T)[np.triu_indices(20, 1)]).max() < 0.25


def test_replicate_sums(spark, monkeypatch):
    rows = [("a", i, float(i % 7), i % 5 == 0) for i in range(60)] + [("b", i, None if i == 2 else 1.5, False) for i in range(5)] + [(None, 0, 2.0, True)]
    df = spark.createDataFrame(rows, "g string, i int, x double, hit boolean")
    b = 200
    keyed = df.withColumn("key", B.hash60(42, B._group_text(["g"]), F.col("i"))).collect()

    def sums(frame):
        out = B.replicate_sums(frame, ["g"], ["i"], {"x": F.col("x")}, b, least=F.when(F.col("hit"), F.col("i")))
        return {(r["g"], r["rep"]): (r["w"], r["x"], r["least"]) for r in out.collect()}

    want = {}
    for g in ("a", "b", None):
        mine = [r for r in keyed if r["g"] == g and r["x"] is not None]
        w = B.poisson_weights(np.array([r["key"] for r in mine]), b)
        for rep in range(b):
            if w[:, rep].sum():
                low = [r["i"] for r, k in zip(mine, w[:, rep]) if k and r["hit"]]
                want[g, rep + 1] = (w[:, rep].sum(), pytest.approx(sum(k * r["x"] for r, k in zip(mine, w[:, rep]))), min(low) if low else None)
    assert sums(df) == want
    monkeypatch.setattr(B, "_CELLS", 300)  # many small parts
    assert sums(df.repartition(5)) == want


def test_many_replicates_copy_no_rows(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(100)], "g string, i int, x double")
    out = B.bootstrap_ci(df, ["g"], "x", ["i"], 10_000)
    plan = out._jdf.queryExecution().toString()
    r = out.first()
    assert r["ci_low"] < 49.5 < r["ci_high"] and r["n_reps"] == 10_000 and r["ci_high"] - r["ci_low"] == pytest.approx(2 * 1.96 * 28.87 / 10, rel=0.1)
    assert "Window" not in plan and "Generate" not in plan
