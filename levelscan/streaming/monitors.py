"""Structured Streaming: level series from events, stateful alarms, deduplication."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_level_aggregates(events: DataFrame, keys: Sequence[str], ts: str, value: str, width: str = "1 day", late: str = "0 seconds") -> DataFrame:
    """One row per key and event-time window; rows later than the watermark are dropped (append mode)."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("_w"), *keys)
    return w.agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.var_samp(value).alias("variance"),
    ).select(*keys, F.col("_w.start").alias("level_start"), "n", "mean_value", "variance")


def stream_dedup(events: DataFrame, keys: Sequence[str], ts: str, late: str = "1 day") -> DataFrame:
    """First row per key inside the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def stream_alarm_monitor(
    levels: DataFrame, keys: Sequence[str] = ("task", "model"), k: int = 3, sigma: float = 2.0, disagree: float = 0.30, dip: float = 0.05,
    h: float = 4.0, lam: float = 0.2, width: float = 2.5, allowance: float = 0.5,
) -> DataFrame:
    """Threshold votes, CUSUM and EWMA of variance per series, with the state (n, mean, M2, S, Z) kept between batches.

    Levels of a series must arrive in order from one batch to the next; inside a batch they are sorted,
    so the result does not depend on where a batch ends and equals the batch form.
    """
    keys = list(keys)
    rows = levels.select(*keys, "level", "variance", "disagreement_rate", "dip_pvalue")
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    out = f"{key_ddl}, level int, protocol string, statistic double, `limit` double, alarmed boolean"
    state_ddl = "n int, mean double, m2 double, s double, z double"

    def step(key, batches, state: GroupState):
        n, mean, m2, s, z = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0)
        pdf = pd.concat(list(batches)).sort_values("level")
        got = []
        for r in pdf.itertuples(index=False):
            n += 1
            x = float(r.variance)
            if n <= k:  # calibration
                d = x - mean
                mean += d / n
                m2 += d * (x - mean)
                z = mean
                continue
            sd = max(math.sqrt(m2 / (k - 1)) if k > 1 else 0.0, 1e-10)
            votes = int(x > mean + sigma * sd) + int(r.disagreement_rate > disagree) + int(r.dip_pvalue < dip)
            s = max(0.0, s + x - mean - allowance * sd)
            z = lam * x + (1 - lam) * z
            t = n - k
            limit = mean + width * sd * math.sqrt(lam / (2 - lam) * (1 - (1 - lam) ** (2 * t)))
            for name, stat, lim, hit in (
                ("any1", votes, 1, votes >= 1), ("any2", votes, 2, votes >= 2), ("all3", votes, 3, votes >= 3),
                (f"cusum_variance_h{h}", s, h * sd, s > h * sd), (f"ewma_variance_l{lam}_L{width}", z, limit, z > limit),
            ):
                got.append((*key, int(r.level), name, float(stat), float(lim), bool(hit)))
        state.update((n, mean, m2, s, z))
        yield pd.DataFrame(got, columns=[*keys, "level", "protocol", "statistic", "limit", "alarmed"])

    return rows.groupBy(*keys).applyInPandasWithState(step, out, state_ddl, "append", GroupStateTimeout.NoTimeout)


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Start a query that takes everything available, writes parquet and stops (exactly once by its checkpoint)."""
    return (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
