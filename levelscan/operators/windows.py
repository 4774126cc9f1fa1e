"""Window features over level series (one row per series and level).

A series holds one row per level, so its window partition is bounded by the number of levels.
Level picks over raw rows (``stratified_pick``) rank with a limit that Spark applies before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SERIES = ("task", "model")


def by_level(keys: Sequence[str] = SERIES, level: str = "level"):
    return W.partitionBy(*keys).orderBy(level)


def _upto(keys: Sequence[str], back: int | None = None):
    return by_level(keys).rowsBetween(W.unboundedPreceding if back is None else -back, 0)


def delta(f: str, keys: Sequence[str] = SERIES) -> Column:
    return F.coalesce(F.col(f) - F.lag(f).over(by_level(keys)), F.lit(0.0))


def acceleration(f: str, keys: Sequence[str] = SERIES) -> Column:
    w = by_level(keys)
    return F.coalesce(F.col(f) - 2 * F.lag(f).over(w) + F.lag(f, 2).over(w), F.lit(0.0))


def rolling_slope(f: str, x: str = "ordinal", keys: Sequence[str] = SERIES) -> Column:
    """OLS slope over the last three levels, by the closed form of each frame size.

    ``ordinal``: x = 0, 1, 2 over up to three rows; ``level``: real levels, exactly three known values.
    """
    w = by_level(keys)
    y0, y1, y2 = F.lag(f, 2).over(w), F.lag(f, 1).over(w), F.col(f)
    if x == "ordinal":
        return F.coalesce((y2 - y0) / 2.0, y2 - y1, F.lit(0.0))
    x0, x1, x2 = F.lag("level", 2).over(w), F.lag("level", 1).over(w), F.col("level")
    mx = (x0 + x1 + x2) / 3.0
    sxy = (x0 - mx) * y0 + (x1 - mx) * y1 + (x2 - mx) * y2
    sxx = F.pow(x0 - mx, 2) + F.pow(x1 - mx, 2) + F.pow(x2 - mx, 2)
    return F.coalesce(sxy / sxx, F.lit(0.0))


def trailing_tau(f: str, size: int = 5, keys: Sequence[str] = SERIES) -> Column:
    """Kendall tau-b of the last ``size`` values against their order; fewer than three, or flat: 0."""
    w = by_level(keys)
    vals = [F.lag(f, size - 1 - i).over(w) if i < size - 1 else F.col(f) for i in range(size)]
    s, ties, n = F.lit(0), F.lit(0), F.lit(0)
    for j in range(size):
        n = n + vals[j].isNotNull().cast("int")
        for i in range(j):
            both = vals[i].isNotNull() & vals[j].isNotNull()
            s = s + F.when(both, F.signum(vals[j] - vals[i])).otherwise(0.0)
            ties = ties + F.when(both & (vals[i] == vals[j]), 1).otherwise(0)
    pairs = n * (n - 1) / 2.0
    return F.when((n < 3) | (pairs == ties), F.lit(0.0)).otherwise(s / F.sqrt(pairs * (pairs - ties)))


def running_z(f: str, ddof: int = 0, keys: Sequence[str] = SERIES) -> Column:
    w = _upto(keys)
    mu = F.avg(f).over(w)
    if ddof == 0:
        sd = F.stddev_pop(f).over(w)
        return F.when(sd < 1e-12, F.lit(0.0)).otherwise((F.col(f) - mu) / sd)
    sd = F.greatest(F.coalesce(F.stddev_samp(f).over(w), F.lit(0.0)), F.lit(1e-10))
    return (F.col(f) - mu) / sd


def running_max_ratio(f: str, keys: Sequence[str] = SERIES) -> Column:
    return F.col(f) / F.greatest(F.abs(F.max(f).over(_upto(keys))), F.lit(1e-10))


def ratio_to_baseline(f: str, keys: Sequence[str] = SERIES) -> Column:
    return F.col(f) / (F.abs(F.first(f).over(by_level(keys))) + 1e-8)


def ratio_to_max(f: str, keys: Sequence[str] = SERIES) -> Column:
    return F.col(f) / (F.abs(F.max(f).over(W.partitionBy(*keys))) + 1e-8)


def pct_rank_avg(f: str, part: Sequence[str] = SERIES) -> Column:
    """Average rank divided by the row count (ties share a rank); not ``percent_rank``."""
    rank = F.rank().over(W.partitionBy(*part).orderBy(f))
    ties = F.count(F.lit(1)).over(W.partitionBy(*part, f))
    return (rank + (ties - 1) / 2.0) / F.count(F.lit(1)).over(W.partitionBy(*part))


def zscore(f: str, part: Sequence[str], rule: str = "eps") -> Column:
    """``eps``: sample std + 1e-8; ``floor``: sample std, below 1e-10 gives 0; ``pop``: population std, flat divides by 1."""
    w = W.partitionBy(*part)
    centred = F.col(f) - F.avg(f).over(w)
    if rule == "eps":
        return centred / (F.stddev_samp(f).over(w) + 1e-8)
    if rule == "floor":
        sd = F.stddev_samp(f).over(w)
        return F.when(sd < 1e-10, F.lit(0.0)).otherwise(centred / sd)
    sd = F.stddev_pop(f).over(w)
    return centred / F.when(sd < 1e-12, F.lit(1.0)).otherwise(sd)


def minmax(f: str, part: Sequence[str], flat: str = "zero") -> Column:
    w = W.partitionBy(*part)
    lo, hi = F.min(f).over(w), F.max(f).over(w)
    if flat == "zero":
        return F.when(hi > lo, (F.col(f) - lo) / (hi - lo)).otherwise(0.0)
    return (F.col(f) - lo) / F.greatest(hi - lo, F.lit(1))


def relative_distance(part: Sequence[str] = ("task",)) -> Column:
    lo = F.min("level").over(W.partitionBy(*part))
    return (F.col("d_star") - F.col("level")) / F.greatest(F.col("d_star") - lo, F.lit(1))


def critical_level(
    series: DataFrame, keys: Sequence[str] = SERIES, limit: float = 0.5, default: str | None = None
) -> DataFrame:
    """First level with accuracy below the limit; ``default='next'`` puts a missing one after the last level."""
    d = F.min(F.when(F.col("accuracy") < limit, F.col("level")))
    if default == "next":
        d = F.coalesce(d, F.max("level") + 1)
    return series.groupBy(*keys).agg(d.alias("d_star"))


def attach_critical_level(
    series: DataFrame, keys: Sequence[str] = SERIES, limit: float = 0.5, default: str | None = None
) -> DataFrame:
    """The same d*, as a column beside every level."""
    w = W.partitionBy(*keys)
    d = F.min(F.when(F.col("accuracy") < limit, F.col("level"))).over(w)
    if default == "next":
        d = F.coalesce(d, F.max("level").over(w) + 1)
    return series.withColumn("d_star", d)


def first_crossing(series: DataFrame, predicate: Column, keys: Sequence[str] = SERIES, guard: Column | None = None) -> DataFrame:
    """First level up to d* where the predicate holds, with lead time and accuracy there."""
    hit = predicate & (F.col("level") <= F.col("d_star"))
    if guard is not None:
        hit = hit & guard
    key = F.when(hit, F.col("level"))
    return series.groupBy(*keys).agg(
        F.max("d_star").alias("d_star"),
        F.min(key).alias("d_lead"),
        F.min_by("accuracy", key).alias("accuracy_at_signal"),
    ).withColumn("lead_time", F.col("d_star") - F.col("d_lead"))


def next_drop_label(series: DataFrame, drop: float = 0.20, keys: Sequence[str] = SERIES) -> DataFrame:
    """1 if accuracy falls by more than ``drop`` at the next level; the last level has no label and goes."""
    nxt = F.lead("accuracy").over(by_level(keys))
    return series.withColumn("_next", nxt).where(F.col("_next").isNotNull()).withColumn(
        "label", (F.col("accuracy") - F.col("_next") > drop).cast("int")
    ).drop("_next")


def calibration_stats(series: DataFrame, f: str, k: int = 3, keys: Sequence[str] = SERIES) -> DataFrame:
    """Mean and sample std of the first ``k`` levels of each series."""
    rn = F.row_number().over(by_level(keys))
    return series.withColumn("_rn", rn).where(F.col("_rn") <= k).groupBy(*keys).agg(
        F.avg(f).alias("cal_mean"), F.coalesce(F.stddev_samp(f), F.lit(0.0)).alias("cal_std")
    )


def stratified_pick(items: DataFrame, n: int, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first ``n`` items per stratum in the given order (row index, or a keyed hash for a random pick)."""
    rn = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return items.withColumn("pick", rn).where(F.col("pick") <= n)


def balanced_pick(items: DataFrame, n: int, by: Sequence[str], output: str, order: Sequence[Column], level: str) -> DataFrame:
    """``n`` items per level, majority/minority split alternating with level parity, topped up from the rest.

    Even levels take more TRUE, odd levels more FALSE.  Only the first ``n`` of each (level, output)
    can ever be chosen, so the second ranking sees at most 2n rows per level.
    """
    big, small = (n + 1) // 2, n // 2
    head = items.withColumn("_r", F.row_number().over(W.partitionBy(*by, output).orderBy(*order))).where(F.col("_r") <= n)
    even = F.pmod(F.col(level), F.lit(2)) == 0
    quota = F.when(even == (F.col(output) == "TRUE"), big).otherwise(small)
    spare = (F.col("_r") > quota).cast("int")
    rank = F.row_number().over(W.partitionBy(*by).orderBy(spare, *order))
    return head.withColumn("pick", rank).where(F.col("pick") <= n).drop("_r")


def section_fill(lines: DataFrame, doc: str, line: str, heading: Column, start: str = "preamble") -> DataFrame:
    """Carry the last heading of each document forward over its lines."""
    w = W.partitionBy(doc).orderBy(line).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("section", F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit(start)))


def variance_jump(series: DataFrame, factor: float = 1.2, keys: Sequence[str] = SERIES) -> DataFrame:
    """First level below d* whose variance exceeds ``factor`` times the previous level's."""
    prev = F.lag("variance").over(by_level(keys))
    jump = (F.col("variance") > prev * factor) & (F.col("level") < F.col("d_star"))
    return series.withColumn("_jump", F.when(jump, F.col("level"))).groupBy(*keys).agg(F.min("_jump").alias("d_jump"))


def variance_rise(series: DataFrame, factor: float = 1.1, keys: Sequence[str] = SERIES) -> DataFrame:
    """First level up to d* whose variance exceeds ``factor`` times the median of the first half."""
    pre = series.where(F.col("level") <= F.col("d_star"))
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    rn = F.row_number().over(by_level(keys))
    pre = pre.withColumn("_half", F.greatest(F.floor(n / 2), F.lit(1))).withColumn("_rn", rn)
    base = pre.where(F.col("_rn") <= F.col("_half")).groupBy(*keys).agg(F.percentile("variance", 0.5).alias("base_variance"))
    return pre.join(base, list(keys)).groupBy(*keys).agg(
        F.max("base_variance").alias("base_variance"),
        F.min(F.when(F.col("variance") > factor * F.col("base_variance"), F.col("level"))).alias("d_rise"),
    )
