"""Running sums over chunks of one key, against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelscan.plans import prefix


def data(kind):
    rng = np.random.default_rng(5)
    if kind == "two tight clusters":
        return np.r_[rng.normal(0, 1e-9, 3000), 1e6 + rng.normal(0, 1e-6, 3000)]
    if kind == "heavy tail":
        return np.exp(rng.normal(0, 8, 4000))
    if kind == "few values":
        return rng.integers(0, 3, 500).astype(float)
    return rng.integers(-5000, 5000, 6000).astype(float)


@pytest.mark.parametrize("kind", ["two tight clusters", "heavy tail", "few values", "even"])
@pytest.mark.parametrize("chunks", [128, 10, 2])
def test_running_sums(spark, kind, chunks):
    x = data(kind)
    v, c = np.unique(x, return_counts=True)
    df = spark.createDataFrame([("k", float(a), int(b)) for a, b in zip(v, c)] + [("one", 1.0, 4), ("other", 2.0, 1), ("other", 3.0, 2)], "key string, v double, cnt long")
    got = prefix.running_sums(df, ["key"], "v", ["cnt"], chunks).orderBy("v").collect()
    mine = [r for r in got if r["key"] == "k"]
    assert [r["cum_cnt"] for r in mine] == np.cumsum(c).tolist() and {r["total_cnt"] for r in mine} == {len(x)}
    assert [r["next_value"] for r in mine] == [*v[1:].tolist(), None]
    assert [(r["cum_cnt"], r["next_value"]) for r in got if r["key"] == "other"] == [(1, 3.0), (3, None)]
    cut = df.where("key = 'k'").groupBy("key").agg(prefix.chunk_cuts(F.col("v"), chunks).alias("c")).first()["c"]
    place = [r[0] for r in spark.createDataFrame([(float(a),) for a in v], "v double").select(prefix.chunk_of(F.col("v"), F.array(*[F.lit(q) for q in cut]).cast("array<double>"), chunks)).collect()]
    assert place == [sum(q < a for q in cut) for a in v] and place == sorted(place)
    if chunks == 128 and kind != "few values":
        assert len(set(place)) > 100 and max(np.bincount(place)) < 3 * len(v) / 128
