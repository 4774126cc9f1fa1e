"""Few-shot replicates: rows are stored once, and k of the target task join the training set whatever their names."""

import numpy as np
from pyspark.sql import functions as F

from levelscan.operators import learners as L


def test_rows_are_stored_once_for_all_replicates(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [("fr" if i % 3 == 0 else "en" if i % 7 else None, f"m{i % 2}", 0, int(x + rng.normal() > 0), float(x)) for i, x in enumerate(rng.normal(0, 1, 90))]
    df = spark.createDataFrame(rows, "task string, model string, level int, label int, f double").repartition(3)
    seen, real = {}, L.cross_validate

    def spy(rows, variants, schemes, *args, **kw):
        counts = [F.sum(((F.col("task") == "fr") & (e == "train")).cast("int")).alias(n) for n, e in schemes.items()]
        seen.update(rows.agg(F.count(F.lit(1)).alias("n"), *counts).first().asDict())
        return real(rows, variants, schemes, *args, **kw)

    monkeypatch.setattr(L, "cross_validate", spy)
    got = {r["k"]: r for r in L.few_shot_curve(df, ["f"], "fr", ks=(0, 2, 5), seeds=range(4)).collect()}
    assert seen.pop("n") == 90  # not 90 for each of 12 replicates
    assert seen == {f"{s}|{k}": k for s in range(4) for k in (0, 2, 5)}  # names are shared by 15 rows, the draw is not
    assert set(got) == {0, 2, 5} and got[0]["std_f1"] == 0 and all(0.5 < r["mean_f1"] < 1 for r in got.values())
