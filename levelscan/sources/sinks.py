"""Output shaping: formatting, sentinels, metric lists and report grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def format_predictions(df: DataFrame, digits: Mapping[str, int], prefix: str = "predict_") -> DataFrame:
    """Round and turn into text; a missing number becomes 'nan'."""
    def text(c, n):
        return F.coalesce(F.round(F.col(c), n).cast("string"), F.lit("nan")).alias(prefix + c)

    return df.select(*[text(c, digits[c]) if c in digits else F.col(c) for c in df.columns])


def sanitize(df: DataFrame, cols: Sequence[str], sentinel: float = -999.0) -> DataFrame:
    """NaN, infinities and NULL become the sentinel; booleans become 1.0/0.0."""
    types = dict(df.dtypes)

    def clean(c: str) -> Column:
        v = F.col(c).cast("double") if types[c] != "boolean" else F.when(F.col(c), 1.0).when(~F.col(c), 0.0)
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(sentinel)).otherwise(v)

    return df.withColumns({c: clean(c) for c in cols})


def metrics_agg(df: DataFrame, cols: Sequence[str], prefix: Column | None = None) -> DataFrame:
    """Wide metric columns to (metric, value) rows."""
    name = (lambda c: F.concat_ws("_", prefix, F.lit(c))) if prefix is not None else F.lit
    pairs = F.array(*[F.struct(name(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("_m")).select("_m.*")


def report_table(df: DataFrame, row_key: str, col_key: str, value: str, columns: Sequence) -> DataFrame:
    """Mean of ``value`` in a grid; the column list is given, so no extra job looks for it."""
    return df.groupBy(row_key).pivot(col_key, list(columns)).agg(F.avg(value))


def figure_data(df: DataFrame, figure: str) -> DataFrame:
    """Plot-ready rows (series, x, y) of a level table."""
    series = F.concat_ws("__", "task", "model")
    if figure == "accuracy_curve":
        return df.select(series.alias("series"), F.col("level").alias("x"), F.col("accuracy").alias("y"))
    if figure == "indicator_profile":
        cols = ("variance", "disagreement_rate", "bimodality_coefficient")
        mean = df.groupBy("task", "level").agg(*[F.avg(c).alias(c) for c in cols])
        pairs = F.array(*[F.struct(F.concat_ws("__", "task", F.lit(c)).alias("series"), F.col("level").alias("x"), F.col(c).alias("y")) for c in cols])
        return mean.select(F.explode(pairs).alias("_p")).select("_p.*")
    if figure == "boundary_bars":
        g = df.groupBy("task", "model").agg(F.min(F.when(F.col("accuracy") < 0.5, F.col("level"))).alias("x"), F.avg("accuracy").alias("y"))
        return g.select(series.alias("series"), "x", "y")
    raise ValueError(figure)
