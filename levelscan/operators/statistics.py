"""Tests, effect sizes and distances per group.

Two-sample statistics over raw rows first count distinct values (map-side combined) and then use
chunked running sums, so a group holding a third of the data is still spread over many tasks.
Rank statistics of level series (one row per level) use plain windows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType

from levelscan.functions import special as D
from levelscan.plans.prefix import average_ranks, running_sums, value_counts
from levelscan.plans.session import cut_lineage


# ---- rank correlation ---------------------------------------------------------------------------

def kendall(df: DataFrame, keys: Sequence[str], x: str, y: str, large: bool = False, p_value: bool = True) -> DataFrame:
    """Kendall tau-b and its two-sided p per group, without listing pairs.

    Discordant pairs are inversions of y in x order.  Two y ranks differ first at one bit, so
    inversions are counted bit by bit: inside each (bit, higher bits) block, ones seen at smaller x
    before each zero.  Work is n log n in one chain of grouped steps.  Series of levels use plain
    windows; ``large`` uses chunked running sums and joins instead, for groups of raw rows.
    """
    keys = list(keys)
    cells = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .agg(F.count(F.lit(1)).alias("w"))
    )
    if large:
        cells = cut_lineage(cells)
        per_y = running_sums(cells.groupBy(*keys, "_y").agg(F.sum("w").alias("_ty")).withColumn("one", F.lit(1)), keys, "_y", ["one"])
        per_y = per_y.select(*keys, "_y", "_ty", (F.col("cum_one") - 1).alias("_r"), F.col("total_one").alias("_m"))
        per_x = cells.groupBy(*keys, "_x").agg(F.sum("w").alias("_tx"))
        ranked = cells.join(per_y, [*keys, "_y"]).join(per_x, [*keys, "_x"])
    else:
        ranked = cells.withColumn("_r", F.dense_rank().over(W.partitionBy(*keys).orderBy("_y")) - 1)
        ranked = ranked.withColumns({
            "_m": F.max("_r").over(W.partitionBy(*keys)) + 1,
            "_ty": F.sum("w").over(W.partitionBy(*keys, "_y")),
            "_tx": F.sum("w").over(W.partitionBy(*keys, "_x")),
        })
    wd, tx, ty = F.col("w").cast("double"), F.col("_tx"), F.col("_ty")
    # a sum over rows of a tied value of size t, weighted 1/t, is a sum over the values
    parts = {
        "x_tie": wd * (tx - 1) / 2, "y_tie": wd * (ty - 1) / 2, "xy_tie": wd * (wd - 1) / 2,
        "x_t0": wd * (tx - 1) * (tx - 2), "y_t0": wd * (ty - 1) * (ty - 2),
        "x_t1": wd * (tx - 1) * (2 * tx + 5), "y_t1": wd * (ty - 1) * (2 * ty + 5),
    }
    bits = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.col("_m").cast("double"))).cast("int") - 1, F.lit(0)))
    split = ranked.withColumn("_b", F.explode(bits))
    block = F.floor(F.col("_r") / F.pow(F.lit(2.0), F.col("_b") + 1)).cast("long")
    one = (F.floor(F.col("_r") / F.pow(F.lit(2.0), F.col("_b"))) % 2).cast("long")
    once = F.col("_b") == 0
    per = split.groupBy(*keys, "_b", block.alias("_blk"), "_x").agg(
        F.sum(F.col("w") * one).alias("ones"), F.sum(F.col("w") * (1 - one)).alias("zeros"),
        F.sum(F.when(once, F.col("w"))).alias("_n"), *[F.sum(F.when(once, e)).alias(c) for c, e in parts.items()],
    )
    blk = [*keys, "_b", "_blk"]
    if large:
        run = running_sums(per, blk, "_x", ["ones"]).withColumn("_before", F.col("cum_ones") - F.col("ones"))
    else:
        w = W.partitionBy(*blk).orderBy("_x").rowsBetween(W.unboundedPreceding, -1)
        run = per.withColumn("_before", F.coalesce(F.sum("ones").over(w), F.lit(0)))
    out = run.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum(F.col("zeros") * F.col("_before")).cast("double").alias("dis"), *[F.sum(c).alias(c) for c in parts]
    )
    n = F.col("n").cast("double")
    tot = n * (n - 1) / 2
    s = tot - F.col("x_tie") - F.col("y_tie") + F.col("xy_tie") - 2 * F.col("dis")
    den = F.sqrt((tot - F.col("x_tie")) * (tot - F.col("y_tie")))
    out = out.withColumns({"_s": s, "_den": den})
    out = out.withColumn("tau", F.when((n >= 3) & (F.col("_den") > 0), F.col("_s") / F.col("_den")).otherwise(0.0))
    if not p_value:
        return out.select(*keys, "n", "tau")
    m = n * (n - 1)
    var = (
        (m * (2 * n + 5) - F.col("x_t1") - F.col("y_t1")) / 18
        + 2 * F.col("x_tie") * F.col("y_tie") / m
        + F.col("x_t0") * F.col("y_t0") / (9 * m * (n - 2))
    )
    c = F.least(F.col("dis"), tot - F.col("dis")).cast("long")
    exact = (F.col("x_tie") == 0) & (F.col("y_tie") == 0) & (n <= 33)
    degenerate = (n < 3) | (F.col("_den") <= 0)
    out = out.withColumns({"_z": F.when(~degenerate & ~exact, F.abs(F.col("_s")) / F.sqrt(var)), "_c": F.when(exact, c), "_exact": exact, "_deg": degenerate})
    table = inversion_table(df.sparkSession).withColumnsRenamed({"n": "_tn", "c": "_tc"})
    out = out.join(table, (F.col("n") == F.col("_tn")) & (F.col("_c") == F.col("_tc")), "left")
    p = (
        F.when(F.col("_deg"), 1.0)
        .when(F.col("_exact"), F.when(4 * F.col("_c") == n * (n - 1), 1.0).otherwise(F.least(2 * F.col("cdf"), F.lit(1.0))))
        .otherwise(D.normal_two_sided(F.col("_z")))
    )
    return out.select(*keys, "n", "tau", p.alias("p_value"))


def _fixed_table(spark, rows, names) -> DataFrame:
    return spark.createDataFrame(pa.table({c: list(v) for c, v in zip(names, zip(*rows))}))


def inversion_table(spark, n_max: int = 33) -> DataFrame:
    """P(inversions <= c) of a random permutation, for n up to 33 and c up to half of the pairs.

    The counts follow from one recurrence; the table has a fixed size of some thousand rows.
    """
    rows, counts = [], [1]
    for n in range(2, n_max + 1):
        new = [0] * (n * (n - 1) // 2 + 1)
        for k in range(len(new)):
            new[k] = sum(counts[max(0, k - n + 1) : k + 1])
        counts, total, acc = new, math.factorial(n), 0
        for c in range(n * (n - 1) // 4 + 1):
            acc += counts[c]
            rows.append((n, c, acc / total))
    return _fixed_table(spark, rows, ["n", "c", "cdf"])


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; NULL (not an error) when a side is flat."""
    xx, yy = F.regr_sxx(y, x), F.regr_syy(y, x)
    return F.when((xx > 0) & (yy > 0), F.regr_sxy(y, x) / F.sqrt(xx * yy))


def linregress(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), safe_corr(x, y).alias("r")
    )
    return out.withColumn("r2", F.col("r") * F.col("r")).withColumn("p_value", corr_p(F.col("r"), F.col("n")))


def corr_p(r: Column, n: Column) -> Column:
    t = r * F.sqrt(F.try_divide(n - 2, 1 - r * r))
    return F.when(n < 3, None).when(F.abs(r) >= 1, 0.0).otherwise(D.t_two_sided(t, n - 2))


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str, minimum: int = 4) -> DataFrame:
    out = linregress(df, keys, x, y).select(*keys, "n", "r", "p_value")
    return out.withColumns({c: F.when(F.col("n") >= minimum, F.col(c)) for c in ("r", "p_value")})


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks (level series; ranks by windows)."""
    from levelscan.operators.windows import pct_rank_avg

    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ok.select(*keys, pct_rank_avg(x, keys).alias("_rx"), pct_rank_avg(y, keys).alias("_ry"))
    out = linregress(ranked, keys, "_rx", "_ry")
    good = F.col("n") >= 3
    return out.select(*keys, "n", F.when(good, F.col("r")).alias("rho"), F.when(good, F.col("p_value")).alias("p_value"))


def fisher_combine(df: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    out = df.where(F.col(p).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), (-2 * F.sum(F.ln(F.col(p)))).alias("chi2")
    )
    return out.withColumn("p_combined", F.when(F.col("k") >= 2, D.chi2_even_sf(F.col("chi2"), F.col("k"))))


# ---- two samples --------------------------------------------------------------------------------

def _two_sample_counts(df: DataFrame, keys: Sequence[str], value: str, side: str, a, b) -> DataFrame:
    s = F.col(side)
    return value_counts(
        df.where(s.isin(a, b)), keys, value, {"na": (s == a).cast("long"), "nb": (s == b).cast("long")}
    )


def mann_whitney(df: DataFrame, keys: Sequence[str], value: str, side: str, a, b) -> DataFrame:
    """U of sample a, one-sided p (a greater) and Cliff's delta.

    Exact p where one side has up to 8 rows and nothing is tied, whatever the other's size, else the normal form
    with tie and continuity corrections; a side with one value falls back to comparing means.
    """
    s = F.col(side)
    ranks = average_ranks(df.where(s.isin(a, b)), keys, value, {"na": (s == a).cast("long"), "nb": (s == b).cast("long")})
    t = F.col("cnt").cast("double")
    v = F.col(value)
    out = ranks.groupBy(*keys).agg(
        F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"),
        F.sum(F.col("rank_avg") * F.col("na")).alias("_ra"), F.sum(t * t * t - t).alias("_ties"),
        F.try_divide(F.sum(v * F.col("na")), F.sum("na")).alias("mean_a"), F.try_divide(F.sum(v * F.col("nb")), F.sum("nb")).alias("mean_b"),
    )
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    u = F.col("_ra") - na * (na + 1) / 2
    n = na + nb
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    out = out.withColumn("u", u).withColumn("cliffs_delta", F.try_divide(2 * u, na * nb) - 1)
    small = (F.col("_ties") == 0) & (F.least(na, nb) <= 8)
    out = out.withColumn("sf", F.when(small, rank_sum_sf(F.when(small, F.least("n_a", "n_b")), F.when(small, F.greatest("n_a", "n_b")), F.when(small, u))))
    p = (
        F.when((na < 2) | (nb < 2), F.when(F.col("mean_a") > F.col("mean_b"), 0.0).otherwise(1.0))
        .when(F.col("sf").isNotNull(), F.col("sf"))
        .when(sd > 0, D.normal_sf(F.try_divide(F.col("u") - na * nb / 2 - 0.5, sd)))
        .otherwise(1.0)
    )
    return out.select(*keys, "n_a", "n_b", "u", p.alias("p_greater"), "cliffs_delta")


def rank_sum_tail(m: int, n: int, u: int) -> float:
    """P(U >= u) for samples of m <= n rows without ties.

    The number of lattice paths with area k is the coefficient of x^k in the product over i = 1..m of (1 - x^(n+i)) / (1 - x^i): one shifted
    difference and one running sum with stride i per row of the smaller sample.  Beyond 50 million coefficients U / n is the
    sum of m uniform numbers to eight digits.
    """
    if u <= 0:
        return 1.0
    if m * n > 50_000_000:
        x = (m * n - u) / n
        return sum((-1) ** j * math.comb(m, j) * max(x - j, 0.0) ** m for j in range(m + 1)) / math.factorial(m)
    low = min(m * n - u, u - 1)  # by symmetry the shorter tail
    if low < 0:
        return 0.0
    a = np.zeros(low + 1)
    a[0] = 1.0
    for i in range(1, m + 1):
        if n + i <= low:
            a[n + i:] = a[n + i:] - a[:low + 1 - n - i]
        padded = np.zeros(-(-(low + 1) // i) * i)
        padded[:low + 1] = a
        a = np.cumsum(padded.reshape(-1, i), axis=0).ravel()[:low + 1]
    share = float(a.sum()) / math.comb(m + n, m)
    return share if low == m * n - u else 1.0 - share


@F.pandas_udf(DoubleType())
def rank_sum_sf(m: pd.Series, n: pd.Series, u: pd.Series) -> pd.Series:
    return pd.Series([rank_sum_tail(int(a), int(b), round(c)) if a == a and a > 0 else None for a, b, c in zip(m, n, u)], dtype="float64")


def cliffs_delta(df: DataFrame, keys: Sequence[str], value: str, side: str, a, b) -> DataFrame:
    """Mean sign of a - b over all pairs, from the rank sum."""
    return mann_whitney(df, keys, value, side, a, b).select(*keys, "cliffs_delta")


def distribution_distances(df: DataFrame, keys: Sequence[str], value: str, side: str, a, b, counts: DataFrame | None = None) -> DataFrame:
    """Wasserstein-1 distance, KS statistic and its asymptotic p, in one pass of running shares."""
    keys = list(keys)
    counts = _two_sample_counts(df, keys, value, side, a, b) if counts is None else counts
    run = running_sums(counts, keys, value, ["na", "nb"])
    gap = F.abs(F.try_divide("cum_na", "total_na") - F.try_divide("cum_nb", "total_nb"))
    out = run.groupBy(*keys).agg(
        F.max("total_na").alias("n_a"), F.max("total_nb").alias("n_b"),
        F.coalesce(F.sum(gap * (F.col("next_value") - F.col(value))), F.lit(0.0)).alias("wasserstein"),
        F.max(gap).alias("ks"),
    )
    en = F.sqrt(F.try_divide(F.col("n_a") * F.col("n_b"), F.col("n_a") + F.col("n_b")))
    x = en * F.col("ks")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(50)), F.lit(0.0),
        lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x),
    )
    return out.withColumn("ks_p", F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0))))


def cohens_d(df: DataFrame, keys: Sequence[str], value: str, side: str, a, b, small: float | None = None) -> DataFrame:
    """(mean a - mean b) / pooled sample std; ``small`` is the value for a side under two rows or a flat pool."""
    va, vb = F.when(F.col(side) == a, F.col(value)), F.when(F.col(side) == b, F.col(value))
    out = df.groupBy(*keys).agg(
        F.count(va).alias("n_a"), F.count(vb).alias("n_b"), F.avg(va).alias("mean_a"), F.avg(vb).alias("mean_b"),
        F.var_samp(va).alias("_va"), F.var_samp(vb).alias("_vb"), F.stddev_pop(va).alias("std_a"), F.stddev_pop(vb).alias("std_b"),
    )
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = F.sqrt(F.try_divide((na - 1) * F.col("_va") + (nb - 1) * F.col("_vb"), na + nb - 2))
    d = F.when((na >= 2) & (nb >= 2) & (pooled > 1e-12), F.try_divide(F.col("mean_a") - F.col("mean_b"), pooled))
    d = F.coalesce(d, F.lit(small).cast("double")) if small is not None else d
    return out.withColumn("cohens_d", d).drop("_va", "_vb")


def paired_t(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    diff = F.col(a) - F.col(b)
    out = df.where(diff.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("_sd"),
        F.sum((diff > 0).cast("long")).alias("wins"),
    )
    t = F.try_divide("mean_diff", F.col("_sd") / F.sqrt(F.col("n").cast("double")))
    out = out.withColumn("t", F.when((F.col("n") >= 2) & (F.col("_sd") > 0), t))
    return out.withColumn("p_value", F.when(F.col("t").isNotNull(), D.t_two_sided(F.col("t"), F.col("n") - 1))).drop("_sd")


def kl_binned(df: DataFrame, keys: Sequence[str], value: str, side: str, a, b, bins: int = 50, counts: DataFrame | None = None) -> DataFrame:
    """KL(a || b) over equal-width bins on the joint range, one added to every bin; a flat range gives 0.

    Empty bins are summed in closed form, so only filled bins are rows.
    """
    keys = list(keys)
    counts = cut_lineage(_two_sample_counts(df, keys, value, side, a, b)) if counts is None else counts
    stats = counts.groupBy(*keys).agg(
        (F.min(value) - 1e-10).alias("_lo"), (F.max(value) + 1e-10).alias("_hi"), (F.max(value) == F.min(value)).alias("_flat"),
        F.sum("na").alias("_na"), F.sum("nb").alias("_nb"),
    )
    v = F.col(value).cast("double")
    binned = counts.join(stats, keys).withColumn("_bin", F.least(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)))
    per = binned.groupBy(*keys, "_bin").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.max("_na").alias("_na"), F.max("_nb").alias("_nb"), F.max("_flat").alias("_flat"))
    p, q = (F.col("na") + 1) / (F.col("_na") + bins), (F.col("nb") + 1) / (F.col("_nb") + bins)
    p0, q0 = 1.0 / (F.max("_na") + bins), 1.0 / (F.max("_nb") + bins)
    kl = F.sum(p * F.ln(p / q)) + (bins - F.count(F.lit(1))) * p0 * F.ln(p0 / q0)
    return per.groupBy(*keys).agg(F.when(F.max("_flat"), 0.0).otherwise(kl).alias("kl"))


def kde_overlap(df: DataFrame, keys: Sequence[str], value: str, side: str, a, b, points: int = 500, counts: DataFrame | None = None) -> DataFrame:
    """Area under the smaller of two Gaussian density estimates on a common grid; a flat range gives 1.

    Each Arrow batch of distinct values folds its kernels into one grid vector per group, and only
    those vectors are shuffled.
    """
    keys = list(keys)
    counts = cut_lineage(_two_sample_counts(df, keys, value, side, a, b)) if counts is None else counts
    v = F.col(value).cast("double")
    na, nb = F.sum("na"), F.sum("nb")
    ma, mb = F.try_divide(F.sum(v * F.col("na")), na), F.try_divide(F.sum(v * F.col("nb")), nb)
    stats = counts.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), na.alias("_ta"), nb.alias("_tb"), ma.alias("_ma"), mb.alias("_mb"))
    spread = counts.join(stats, keys).groupBy(*keys).agg(
        F.sqrt(F.try_divide(F.sum(F.col("na") * F.pow(v - F.col("_ma"), 2)), F.max("_ta") - 1)).alias("_sa"),
        F.sqrt(F.try_divide(F.sum(F.col("nb") * F.pow(v - F.col("_mb"), 2)), F.max("_tb") - 1)).alias("_sb"),
    )
    width = F.col("_hi") - F.col("_lo")
    bw = F.greatest(width / 20, F.lit(1e-8))
    param = stats.join(spread, keys).select(
        *keys, "_lo", "_hi", "_ta", "_tb", bw.alias("_bw"),
        (bw / (width + 1e-8) * F.col("_sa")).alias("_ha"), (bw / (width + 1e-8) * F.col("_sb")).alias("_hb"),
    )
    work = counts.join(param, keys).select(*keys, v.alias("_v"), "na", "nb", "_lo", "_hi", "_bw", "_ha", "_hb")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields if f.name in keys)
    schema = f"{fields + ', ' if fields else ''}dens array<struct<a: double, b: double>>"
    cols = ["_v", "na", "nb"]

    def fold(batches):
        state: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False) if keys else [((), pdf)]:
                lo, hi, bw_, ha, hb = (float(part[c].iloc[0]) for c in ("_lo", "_hi", "_bw", "_ha", "_hb"))
                grid = np.linspace(lo - 2 * bw_, hi + 2 * bw_, points)
                x, wa, wb = (part[c].to_numpy(float) for c in cols)
                acc = state.setdefault(key, np.zeros((2, points)))
                for start in range(0, len(x), 2048):
                    sl = slice(start, start + 2048)
                    gap = (grid[:, None] - x[None, sl]) ** 2
                    if ha > 0:
                        acc[0] += np.exp(-gap / (2 * ha * ha)) @ wa[sl]
                    if hb > 0:
                        acc[1] += np.exp(-gap / (2 * hb * hb)) @ wb[sl]
        rows = [(*(k if isinstance(k, tuple) else (k,)), [{"a": float(p), "b": float(q)} for p, q in acc.T]) for k, acc in state.items()]
        yield pd.DataFrame(rows, columns=[*keys, "dens"])

    parts = work.mapInPandas(fold, schema).select(*keys, F.posexplode("dens").alias("_i", "_d"))
    sums = parts.groupBy(*keys, "_i").agg(F.sum("_d.a").alias("sa"), F.sum("_d.b").alias("sb")).join(param, keys)
    root = math.sqrt(2 * math.pi)
    low = F.least(F.try_divide("sa", F.col("_ta") * F.col("_ha") * root), F.try_divide("sb", F.col("_tb") * F.col("_hb") * root))
    weight = F.when(F.col("_i").isin(0, points - 1), 0.5).otherwise(1.0)
    step = (F.col("_hi") - F.col("_lo") + 4 * F.col("_bw")) / (points - 1)
    area = F.sum(low * weight * step)
    return sums.groupBy(*keys).agg(F.when(F.max(F.col("_hi") - F.col("_lo")) < 1e-12, 1.0).otherwise(area).alias("overlap"))


def feature_shift(df: DataFrame, keys: Sequence[str], value: str, side: str, a, b) -> DataFrame:
    """All distances of one long (feature, variant, value) table, ranked by Wasserstein; sides need 3 values."""
    keys = list(keys)
    counts = cut_lineage(_two_sample_counts(df, keys, value, side, a, b))  # shared by the three distances
    out = cohens_d(df, keys, value, side, a, b, small=0.0).where("n_a >= 3 and n_b >= 3")
    out = out.join(distribution_distances(df, keys, value, side, a, b, counts).drop("n_a", "n_b"), keys)
    out = out.join(kl_binned(df, keys, value, side, a, b, counts=counts), keys).join(kde_overlap(df, keys, value, side, a, b, counts=counts), keys)
    return out.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("wasserstein").desc(), *keys)))


# ---- agreement and intervals --------------------------------------------------------------------

def fleiss_kappa(ratings: DataFrame, subject: Sequence[str], rating: str) -> DataFrame:
    """Kappa over subjects x raters x categories; under two subjects or no spread: 0."""
    cells = ratings.groupBy(*subject, rating).agg(F.count(F.lit(1)).alias("c"))
    per = cells.groupBy(*subject).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    p_bar = per.agg(
        F.count(F.lit(1)).alias("n_subjects"),
        F.avg((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("p_bar"),
    )
    cat = cells.groupBy(rating).agg(F.sum("c").alias("c"))
    share = F.col("c") / F.sum("c").over(W.partitionBy(F.lit(0)))
    pe = cat.select(share.alias("_s")).agg(F.sum(F.col("_s") * F.col("_s")).alias("pe"))
    both = p_bar.withColumn("_k", F.lit(0)).join(pe.withColumn("_k", F.lit(0)), "_k")
    k = (F.col("p_bar") - F.col("pe")) / (1 - F.col("pe"))
    return both.select("n_subjects", F.when((F.col("n_subjects") >= 2) & (1 - F.col("pe") > 1e-10), k).otherwise(0.0).alias("kappa"))


def concordance(ratings: DataFrame, task: str, indicator: str, rating: str) -> DataFrame:
    """Per task pair: share of indicators whose mean ratings agree in sign, or are both below 0.1."""
    m = ratings.groupBy(task, indicator).agg(F.avg(rating).alias("m"))
    a = m.select(F.col(task).alias("task1"), indicator, F.col("m").alias("m1"))
    b = m.select(F.col(task).alias("task2"), indicator, F.col("m").alias("m2"))
    both = a.join(b, indicator).where("task1 < task2")
    agree = (F.signum("m1") == F.signum("m2")) | ((F.abs("m1") < 0.1) & (F.abs("m2") < 0.1))
    return both.groupBy("task1", "task2").agg(F.avg(agree.cast("double")).alias("concordance"))


def wilson_ci(p: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    den = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / den
    half = z / den * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    lo, hi = F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))
    return F.when(n > 0, lo).otherwise(0.0), F.when(n > 0, hi).otherwise(1.0)


def clopper_pearson_ci(k: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    kd, nd = k.cast("double"), n.cast("double")
    lo = F.when(k <= 0, 0.0).otherwise(D.beta_ppf(F.lit(alpha / 2), F.greatest(kd, F.lit(0.5)), nd - kd + 1))
    hi = F.when(k >= n, 1.0).otherwise(D.beta_ppf(F.lit(1 - alpha / 2), kd + 1, F.greatest(nd - kd, F.lit(0.5))))
    return lo, hi


def mean_ci95(df: DataFrame, keys: Sequence[str], value: str, population: bool = False) -> DataFrame:
    sd = F.stddev_pop(value) if population else F.stddev_samp(value)
    n = F.count(value)
    half = F.when(n >= 2, 1.96 * sd / F.sqrt(n.cast("double"))).otherwise(0.0)
    return df.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean_value"), half.alias("ci95"))
