"""Silhouette by pairs of blocks and packed vectors, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelscan.operators import indicators as I


def rows_of(spark, x, c=None):
    cluster = [None] * len(x) if c is None else [int(k) for k in c]
    return spark.createDataFrame([("a", i, [float(t) for t in r], k) for i, (r, k) in enumerate(zip(x, cluster))], "g string, id int, v array<double>, cluster int").repartition(3)


@pytest.mark.parametrize("block,tile", [(7, 3), (8192, 256)])
def test_silhouette_of_blocks_and_tiles(spark, block, tile):
    x = np.random.default_rng(2).normal(0, 1, (60, 3))
    x[40:] = x[5] + 1e6  # copies, far from the origin
    c = (np.arange(60) % 3 == 0).astype(int)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    own, other = c[:, None] == c[None], c[:, None] != c[None]
    a, b = (dist * own).sum(1) / (own.sum(1) - 1), (dist * other).sum(1) / other.sum(1)
    got = I.silhouette_k2(rows_of(spark, x, c), ["g"], "id", "v", block=block, tile=tile).collect()
    assert [(r["g"], r["n"]) for r in got] == [("a", 60)]
    assert got[0]["silhouette_k2"] == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-9)


def test_vectors_are_packed_once_for_all_starts(spark):
    x = np.random.default_rng(3).normal(0, 1, (50, 4))
    packed = I._packed(rows_of(spark, x), ["g"], "v")
    got = np.concatenate([np.frombuffer(r["_x"], float).reshape(r["_m"], -1) for r in packed.collect()])
    assert sorted(map(tuple, got)) == sorted(map(tuple, x))
    c = np.stack([x[:4], x[4:8]], 1)
    state = spark.createDataFrame([("a", c.ravel().tolist(), [True, True, False, True])], "g string, _c array<double>, _live array<boolean>")
    sums = np.array([r["s"] for r in packed.join(state, "g").select(I._cluster_sums("_m", "_x", "_c", "_live").alias("s")).collect()]).sum(0).reshape(4, 2, 5)
    assert not sums[2].any()
    for s in (0, 1, 3):
        one = ((x - c[s, 1]) ** 2).sum(1) < ((x - c[s, 0]) ** 2).sum(1)
        for k, part in enumerate((x[~one], x[one])):
            assert sums[s, k, 0] == len(part) and np.allclose(sums[s, k, 1:], part.sum(0))
