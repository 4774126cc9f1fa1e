"""Bootstrap and permutation inference with keyed draws.

Statistics that are sums are redrawn by weights: how often a row comes in a replicate is a Poisson(1) draw from a hash of (seed,
group, row, replicate).  Rows are neither numbered nor copied; a task adds up all replicates of its rows, so 10,000 of them cost
10,000 sums a group and task.  Other statistics draw positions: md5 of (seed, group, replicate, position).  Neither depends on
task order, and both are the same after a retry.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from levelscan.functions.special import normal_cdf, normal_ppf
from levelscan.plans.draws import coin, hash32, hash60
from levelscan.plans.parallel import spread


def _group_text(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *keys) if keys else F.lit("")


#: P(Poisson(1) <= k): a uniform number at or above the first k of them means k.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(18)]
_CELLS = 4_000_000  # weights that a task draws at once, and sums that it holds before it sends them


def poisson_weights(keys: np.ndarray, b: int) -> np.ndarray:
    """(rows, b) draws: splitmix64 of a row's key and the replicate 1..b, by inversion."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[:, None] + np.arange(1, b + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return np.searchsorted(np.array(POISSON), (z >> np.uint64(11)) * 2.0**-53, side="right").astype(np.float64)


def replicate_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column], b: int, seed: int = 42, least: Column | None = None) -> DataFrame:
    """One row per (keys, rep): ``w``, the rows drawn, the weighted sum of each value, and the ``least`` value drawn.

    ``order`` names a row within its group.  Rows without one of the values take no part; a row without ``least`` counts, but not there.
    """
    keys, names = list(keys), list(values)
    given = df.select(*keys, hash60(seed, _group_text(keys), *[F.col(o) for o in order]).alias("_key"), *[c.cast("double").alias(f"_v{i}") for i, c in enumerate(values.values())],
                      (F.lit(None) if least is None else least).cast("double").alias("_least"))
    for i in range(len(names)):
        given = given.where(F.col(f"_v{i}").isNotNull())
    kinds = dict(given.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["rep int", "w double", *[f"_v{i} double" for i in range(len(names))], "least double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        kind: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            groups = list(held)
            cols = [pa.array([g[i] for g in groups for _ in range(b)], kind[i]) for i in range(len(keys))]
            sums, lows = np.stack([held[g][0] for g in groups]), np.concatenate([held[g][1] for g in groups])
            cols += [pa.array(np.tile(np.arange(1, b + 1, dtype=np.int32), len(groups)))] + [pa.array(sums[:, i].ravel()) for i in range(sums.shape[1])]
            cols.append(pa.array(lows, mask=np.isinf(lows)))
            held.clear()
            return pa.RecordBatch.from_arrays(cols, [*keys, "rep", "w", *[f"_v{i}" for i in range(len(names))], "least"])

        for batch in batches:
            kind = [batch.schema.field(i).type for i in range(len(keys))]
            group_of = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))], strict=True)) if keys else [()] * batch.num_rows
            number = {g: i for i, g in enumerate(dict.fromkeys(group_of))}
            of = np.array([number[g] for g in group_of], np.int64)
            key = batch.column("_key").to_numpy()
            v = np.stack([np.ones(len(key)), *[batch.column(f"_v{i}").to_numpy(zero_copy_only=False) for i in range(len(names))]])
            low = batch.column("_least").to_numpy(zero_copy_only=False).astype(np.float64)
            size = max(1, _CELLS // b)
            for g, i in number.items():
                at = np.flatnonzero(of == i)
                for part in (at[j:j + size] for j in range(0, len(at), size)):
                    drawn = poisson_weights(key[part], b)
                    total, first = held.get(g) or [np.zeros((len(v), b)), np.full(b, np.inf)]
                    known = ~np.isnan(low[part])
                    if known.any():
                        first = np.minimum(first, np.where(drawn[known] > 0, low[part][known][:, None], np.inf).min(0))
                    held[g] = [total + v[:, part] @ drawn, first]
                if len(held) * b * len(v) > _CELLS:
                    yield flush()
        if held:
            yield flush()

    parts = given.mapInArrow(run, schema)
    out = parts.groupBy(*keys, "rep").agg(F.sum("w").alias("w"), *[F.sum(f"_v{i}").alias(n) for i, n in enumerate(names)], F.min("least").alias("least"))
    return out.where("w > 0")


def bootstrap_means(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], b: int, seed: int = 42) -> DataFrame:
    """One row per (keys, rep) with the redrawn mean as ``stat``."""
    return replicate_sums(df, keys, order, {"x": F.col(value)}, b, seed).select(*keys, "rep", (F.col("x") / F.col("w")).alias("stat"))


def resample(df: DataFrame, keys: Sequence[str], order: Sequence[str], b: int, seed: int = 42, cols: Sequence[str] = ()) -> DataFrame:
    """B resamples with replacement per group: rows (keys, rep, cols)."""
    keys = list(keys)
    w = W.partitionBy(*keys)
    pos = df.select(
        *keys, *cols, (F.row_number().over(w.orderBy(*order)) - 1).cast("long").alias("_pos"), F.count(F.lit(1)).over(w).alias("_n")
    )
    draws = pos.select(*keys, "_pos", "_n", F.explode(F.sequence(F.lit(1), F.lit(b))).alias("rep"))
    pick = hash60(seed, _group_text(keys), F.col("rep"), F.col("_pos")) % F.col("_n")
    draws = draws.select(*keys, "rep", pick.alias("_pos"))
    return draws.join(pos.drop("_n"), [*keys, "_pos"]).drop("_pos")


def bootstrap(df: DataFrame, keys: Sequence[str], order: Sequence[str], stat: Callable[[], Column], b: int, cols: Sequence[str], seed: int = 42) -> DataFrame:
    """One row per (keys, rep) with ``stat``."""
    return resample(df, keys, order, b, seed, cols).groupBy(*keys, "rep").agg(stat().alias("stat"))


def percentile_interval(reps: DataFrame, keys: Sequence[str], lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    return reps.groupBy(*keys).agg(
        F.percentile("stat", lo).alias("ci_low"), F.percentile("stat", hi).alias("ci_high"), F.count("stat").alias("n_reps")
    )


def bootstrap_ci(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], b: int = 1000, stat: str = "mean", seed: int = 42) -> DataFrame:
    pick = {"mean": lambda: F.avg(value), "median": lambda: F.percentile(value, 0.5)}[stat]
    point = df.groupBy(*keys).agg(pick().alias("point"))
    reps = bootstrap_means(df, keys, value, order, b, seed) if stat == "mean" else bootstrap(df, keys, order, pick, b, [value], seed)
    return point.join(percentile_interval(reps, keys), list(keys))


def bca_ci(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], b: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Bias-corrected accelerated interval of the mean; fewer than two rows give NULLs."""
    keys = list(keys)
    v = F.col(value).cast("double")
    stats = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("point"))
    # leave-one-out means have mean ``point``, so their deviations are (x - point) / (n - 1)
    dev = (v - F.col("point")) / (F.col("n") - 1)
    acc = df.select(*keys, value).join(stats.where("n >= 2"), keys).groupBy(*keys).agg(
        F.sum(F.pow(dev, 3)).alias("_d3"), F.sum(F.pow(dev, 2)).alias("_d2"))
    reps = bootstrap_means(df, keys, value, order, b, seed)
    below = reps.join(stats.select(*keys, "point"), keys).groupBy(*keys).agg(
        F.avg((F.col("stat") < F.col("point")).cast("double")).alias("_share"),
        F.sort_array(F.collect_list("stat")).alias("_reps"),  # B values per group
    )
    out = stats.join(acc, keys, "left").join(below, keys)
    out = out.withColumn("_z0", normal_ppf(F.least(F.greatest(F.col("_share"), F.lit(1e-8)), F.lit(1 - 1e-8))))
    out = out.withColumn("_a", F.when(F.col("_d2") > 0, F.col("_d3") / (6 * F.pow("_d2", 1.5))).otherwise(0.0))
    from statistics import NormalDist

    for name, q in (("ci_low", alpha / 2), ("ci_high", 1 - alpha / 2)):
        z = F.col("_z0") + NormalDist().inv_cdf(q)
        share = normal_cdf(F.col("_z0") + z / (1 - F.col("_a") * z))
        out = out.withColumn("_at", F.least(F.greatest(share, F.lit(0.5 / b)), F.lit(1 - 0.5 / b)) * (b - 1))
        lo = F.get("_reps", F.floor("_at").cast("int"))
        hi = F.get("_reps", F.least(F.floor("_at") + 1, F.lit(b - 1)).cast("int"))
        out = out.withColumn(name, F.when(F.col("n") >= 2, lo + (hi - lo) * (F.col("_at") - F.floor("_at"))))
    return out.select(*keys, "n", "point", "ci_low", "ci_high")


def bootstrap_effect(df: DataFrame, keys: Sequence[str], value: str, side: str, a, b_side, order: Sequence[str], b: int = 500, seed: int = 42) -> DataFrame:
    """Interval of Cohen's d with both samples redrawn separately; replicates of equal rows on either side have none."""
    two = df.where(F.col(side).isin(a, b_side))
    middle = two.groupBy(*keys).agg(F.avg(value).alias("_mid"), F.stddev_pop(value).alias("_sd"))  # squares are summed about the group's mean
    two = two.join(middle.select(*keys, "_mid"), list(keys))
    x = F.col(value).cast("double") - F.col("_mid")
    sums = replicate_sums(two, [*keys, side], order, {"x": x, "xx": x * x}, b, seed)

    def of(which, c):
        return F.max(F.when(F.col(side) == which, F.col(c)))

    per = sums.groupBy(*keys, "rep").agg(*[of(s, c).alias(f"{c}_{i}") for i, s in enumerate((a, b_side)) for c in ("w", "x", "xx")]).join(middle.select(*keys, "_sd"), list(keys))
    inside = sum(F.col(f"xx_{i}") - F.col(f"x_{i}") ** 2 / F.col(f"w_{i}") for i in (0, 1))
    pooled = F.sqrt(F.greatest(inside, F.lit(0.0)) / (F.col("w_0") + F.col("w_1") - 2))
    d = F.when((F.col("w_0") >= 2) & (F.col("w_1") >= 2) & (pooled > 1e-6 * F.col("_sd")), (F.col("x_0") / F.col("w_0") - F.col("x_1") / F.col("w_1")) / pooled)
    return percentile_interval(per.select(*keys, d.alias("stat")), keys)


def bootstrap_lead_time(series: DataFrame, predicate: Column, b: int = 500, seed: int = 42, keys: Sequence[str] = ("task", "model"), minimum: int = 4, valid: float = 0.1) -> DataFrame:
    """Resample levels up to d*, find the first signalling level again, lead time interval.

    Under ``minimum`` levels, or under a 10 % share of replicates with a signal, the result is NULL.
    """
    keys = list(keys)
    pre = series.where(F.col("level") <= F.col("d_star")).withColumn("_hit", F.coalesce(predicate, F.lit(False)))
    size = pre.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_levels"), F.max("d_star").alias("_d"))
    reps = replicate_sums(pre, keys, ["level"], {}, b, seed, F.when(F.col("_hit"), F.col("level")))
    first = reps.join(size.select(*keys, "_d"), keys).select(*keys, "rep", (F.col("_d") - F.col("least")).alias("stat"))
    size = size.drop("_d")
    out = percentile_interval(first, keys).join(first.groupBy(*keys).agg(F.avg("stat").alias("mean_lead")), keys).join(size, keys)
    ok = (F.col("n_levels") >= minimum) & (F.col("n_reps") >= valid * b)
    return out.withColumns({c: F.when(ok, F.col(c)) for c in ("ci_low", "ci_high", "mean_lead")})


def paired_permutation_f1(df: DataFrame, keys: Sequence[str], row_id: str, y: str, a: str, b: str, p: int = 200, seed: int = 42, add_one: bool = False) -> DataFrame:
    """Swap the two predictions per row at random; share of replicates whose F1 gap reaches the observed one.

    Rows with equal predictions are the same swapped or not, so they are only counted, once for all replicates.  The other rows are
    spread over the cores, and a replicate is their sums over the swapped rows; the shuffle carries these sums only.
    """
    keys = list(keys)

    def one(c):
        return F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))

    rows = df.dropna(subset=keys).select(*keys, F.col(row_id).alias("_id"), one(y).alias("_y"), one(a).alias("_a"), one(b).alias("_b"))
    total = rows.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in {
        "_ny": F.col("_y"), "_na": F.col("_a"), "_nb": F.col("_b"), "_ta": F.col("_a") * F.col("_y"), "_tb": F.col("_b") * F.col("_y")}.items()])
    gain = F.col("_b") - F.col("_a")
    apart = spread(rows.where("_a <> _b").select(*keys, "_id", gain.alias("_g"), (gain * F.col("_y")).alias("_gy")))
    swapped = apart.select("*", F.explode(F.sequence(F.lit(1), F.lit(p))).alias("rep")).where(coin(seed, _group_text(keys), F.col("rep"), F.col("_id")))
    moved = swapped.groupBy(*keys, "rep").agg(F.sum("_g").alias("_g"), F.sum("_gy").alias("_gy"))
    per = total.select("*", F.explode(F.sequence(F.lit(1), F.lit(p))).alias("rep")).join(moved, [*keys, "rep"], "left").fillna(0, ["_g", "_gy"])

    def f1(tp, hats):
        return F.when(hats + F.col("_ny") > 0, 2.0 * tp / (hats + F.col("_ny"))).otherwise(0.0)

    def gap(gy, g):
        return F.abs(f1(F.col("_ta") + gy, F.col("_na") + g) - f1(F.col("_tb") - gy, F.col("_nb") - g))

    observed = f1(F.col("_ta"), F.col("_na")) - f1(F.col("_tb"), F.col("_nb"))
    hits = F.sum((gap(F.col("_gy"), F.col("_g")) >= F.abs(observed) - 1e-12).cast("long"))
    share = (hits + 1) / (F.count(F.lit(1)) + 1) if add_one else hits / F.count(F.lit(1))
    return per.groupBy(*keys).agg(F.max(observed).alias("observed"), share.alias("p_value"))


def permute_within(df: DataFrame, cols: Sequence[str], group: Sequence[str], row_id: str, seed: int | Column = 42) -> DataFrame:
    """Shuffle each column on its own inside the group; other columns stay.  A column as seed gives each of its values an order of its own."""
    group = list(group)
    rest = [c for c in df.columns if c not in cols]
    base = df.select(*rest, F.row_number().over(W.partitionBy(*group).orderBy(row_id)).alias("_r"))
    for c in cols:
        order = [hash32(seed, F.lit(c), F.col(row_id)), F.col(row_id)]
        moved = df.select(*group, c, F.row_number().over(W.partitionBy(*group).orderBy(*order)).alias("_r"))
        base = base.join(moved, [*group, "_r"])
    return base.drop("_r").select(df.columns)
