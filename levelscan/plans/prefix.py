"""Running sums over one huge ordered group, in parallel.

A plain ``Window.partitionBy(key).orderBy(value)`` sends a whole key to one task.  Here each
key is first cut into ordered chunks of about equally many distinct values, sums run inside ``(key, chunk)``, and the few chunk
totals of a key give the offsets.  A sketch places the cuts, whatever the values' distribution; the sums are exact wherever they lie.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from levelscan.plans.session import cut_lineage


def value_counts(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct (keys, value) with ``cnt`` and further sums (map-side combined)."""
    aggs = [F.count(F.lit(1)).alias("cnt")]
    aggs += [F.sum(c).alias(n) for n, c in (sums or {}).items()]
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*aggs)


def chunk_cuts(value: Column, chunks: int) -> Column:
    """Aggregate: rising cut points that share the rows of a key out evenly, by a mergeable quantile sketch.

    The sketch only sets where a chunk ends (within a thousandth of the ranks); sums over the chunks stay exact.
    """
    return F.percentile_approx(value, F.array(*[F.lit(i / chunks) for i in range(1, chunks)]), F.lit(8 * chunks))


def chunk_of(value: Column, cuts: Column, chunks: int) -> Column:
    """How many cuts lie below the value: order-preserving, looked up in two steps of about sqrt(chunks) comparisons."""
    step = max(1, math.isqrt(chunks))
    coarse = F.array(*[F.get(cuts, F.lit(i)) for i in range(step - 1, chunks - 1, step)])
    block = F.size(F.filter(coarse, lambda c: c < value))
    return block * step + F.size(F.filter(F.slice(cuts, block * step + 1, F.lit(step - 1) if step > 1 else F.lit(0)), lambda c: c < value))


def running_sums(
    df: DataFrame, keys: Sequence[str], value: str, cols: Sequence[str], chunks: int = 128
) -> DataFrame:
    """Add ``cum_<c>`` (inclusive), ``total_<c>`` and ``next_value`` to one-row-per-value data.

    The data is written once to the shared folder, so the rows it was counted from are scanned once.
    """
    keys = list(keys)
    df = cut_lineage(df)  # read three times below
    v = F.col(value).cast("double")
    stats = df.groupBy(*keys).agg(chunk_cuts(v, chunks).alias("_cuts"))
    cut = df.join(stats, keys).withColumn("_chunk", chunk_of(v, F.col("_cuts"), chunks).cast("long")).drop("_cuts")
    totals = cut.groupBy(*keys, "_chunk").agg(
        F.min(value).alias("_first"), *[F.sum(c).alias(f"_sum_{c}") for c in cols]
    )
    by_chunk = W.partitionBy(*keys).orderBy("_chunk")
    before = by_chunk.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(*keys)
    offsets = totals.select(
        *keys,
        "_chunk",
        F.lead("_first").over(by_chunk).alias("_next_first"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in cols],
        *[F.sum(f"_sum_{c}").over(everything).alias(f"total_{c}") for c in cols],
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(value)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    local = cut.select(
        "*",
        F.lead(value).over(inside).alias("_next"),
        *[F.sum(c).over(upto).alias(f"_run_{c}") for c in cols],
    )
    out = local.join(offsets, [*keys, "_chunk"])
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_run_{c}") + F.col(f"_off_{c}"))
    out = out.withColumn("next_value", F.coalesce("_next", "_next_first"))
    return out.drop("_chunk", "_next", "_next_first", *[f"_run_{c}" for c in cols], *[f"_off_{c}" for c in cols])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values with their mid-rank ``rank_avg`` (ties share the mean rank)."""
    counted = value_counts(df, keys, value, sums)
    run = running_sums(counted, keys, value, ["cnt", *(sums or {})])
    return run.withColumn("rank_avg", F.col("cum_cnt") - (F.col("cnt") - 1) / 2.0)
