"""Two-means with restarts against plain Lloyd rounds from the same starts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelscan.operators import indicators as I


def lloyd(x, c0, c1):
    while True:
        near = ((x - c1) ** 2).sum(1) < ((x - c0) ** 2).sum(1)
        n0 = x[~near].mean(0) if (~near).any() else x[near].mean(0)
        n1 = x[near].mean(0) if near.any() else n0
        if np.allclose(n0, c0, atol=1e-9) and np.allclose(n1, c1, atol=1e-9):
            return np.minimum(((x - n0) ** 2).sum(1), ((x - n1) ** 2).sum(1)).sum(), near
        c0, c1 = n0, n1


def test_best_of_ten_starts(spark):
    rng = np.random.default_rng(7)
    groups = {"three": np.concatenate([rng.normal(m, 0.5, (15, 2)) for m in ((0, 0), (0, 9), (20, 4))]), "one": np.ones((6, 2)), "single": np.zeros((1, 2)), "noise": rng.normal(0, 1, (40, 2))}
    df = spark.createDataFrame([(g, i, [float(t) for t in r]) for g, x in groups.items() for i, r in enumerate(x)], "g string, id int, v array<double>")
    got = {}
    for r in I.kmeans2(df.repartition(5), ["g"], "v").collect():
        got.setdefault(r["g"], {})[r["id"]] = r["cluster"]
    assert {g: len(c) for g, c in got.items()} == {g: len(x) for g, x in groups.items()}
    assert set(got["one"].values()) == {0} and got["single"] == {0: 0}
    many = df.select("g", F.col("v").alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("_start"))
    starts = I._spread_starts(many, ["g", "_start"], "_v", 42).collect()
    for g in ("three", "noise"):
        x = groups[g]
        runs = [lloyd(x, np.array(r["c0"]), np.array(r["c1"]))[0] for r in starts if r["g"] == g]
        lab = np.array([got[g][i] for i in range(len(x))])
        inertia = sum(((x[lab == k] - x[lab == k].mean(0)) ** 2).sum() for k in (0, 1))
        assert len(runs) == 10 and inertia == pytest.approx(min(runs), rel=1e-9)
    with pytest.raises(RuntimeError):
        I.kmeans2(df.where("g = 'noise'"), ["g"], "v", rounds=1)
