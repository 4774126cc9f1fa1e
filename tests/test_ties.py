"""Rows that are alike get probabilities that tie, whatever the features' means."""

import numpy as np
from pyspark.sql import functions as F

from levelscan.operators.newton import cross_validate


def test_rows_alike_tie_when_left_out_alone(spark):
    rng = np.random.default_rng(6)
    x = 3000 + rng.integers(0, 12, 240) / 7
    y = (rng.random(240) < 0.3 + 0.02 * (x - 3000)).astype(int)
    df = spark.createDataFrame([(i, float(v), int(t)) for i, (v, t) in enumerate(zip(x, y))], "i int, x double, label int").repartition(4)
    out = cross_validate(df, {"x": ["x"]}, {"row": F.col("i")}, min_test=1, carry=("x",))
    alike = out.groupBy("x", "y").agg((F.max("p") - F.min("p")).alias("gap"), F.count("*").alias("n")).where("n > 1").collect()
    assert len(alike) > 12 and max(r["gap"] for r in alike) < 2e-15
