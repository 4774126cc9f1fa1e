"""Sequential alarms over level series, in batch form.

Recursions are rewritten so that each series is one sorted window pass: CUSUM by the running minimum
of a cumulative sum, EWMA by composing affine maps over chunks of the series.
Alarm tables are long: (series, protocol, level, statistic, limit, alarmed), calibration levels left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SERIES = ("task", "model")
FLOOR = 1e-10
EWMA_CHUNK = 64  # values; 1 / (1 - lam)^64 stays far within a double for lam up to 0.9999


def _w(keys):
    return W.partitionBy(*keys).orderBy("level")


def calibrate(series: DataFrame, inds: Sequence[str], k: int = 3, keys: Sequence[str] = SERIES, ddof: int = 1) -> DataFrame:
    """Adds row number, and mean and std of the first k levels per indicator."""
    full = W.partitionBy(*keys)
    out = series.withColumn("_rn", F.row_number().over(_w(keys)))
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    cols = {}
    for c in inds:
        head = F.when(F.col("_rn") <= k, F.col(c))
        cols[f"_mu_{c}"] = F.avg(head).over(full)
        cols[f"_sd_{c}"] = F.coalesce(sd(head).over(full), F.lit(0.0))
    return out.withColumns(cols)


def _cusum_stat(df: DataFrame, c: str, keys, slack: Column, out: str, k: int) -> DataFrame:
    """S_t = C_t - min(0, running min C), C = cumulative sum of x - mu - slack after calibration."""
    run = _w(keys).rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("_rn") > k, F.col(c) - F.col(f"_mu_{c}") - slack)
    df = df.withColumn("_c", F.sum(step).over(run))
    return df.withColumn(out, F.col("_c") - F.least(F.lit(0.0), F.min("_c").over(run))).drop("_c")


def _ewma_stat(df: DataFrame, c: str, lam: float, keys, k: int, out: str, chunk: int = EWMA_CHUNK) -> DataFrame:
    """z = lam x + (1 - lam) z from the calibration mean on, over the known values after calibration.

    A step is an affine map of z, and so is any stretch of steps: z -> q^length z + (its own weighted sum), q = 1 - lam.  The series is cut into
    chunks; a running sum of x / q^place gives the map up to each row of a chunk, and the maps of the chunks before, folded in
    order, give the z that the chunk starts with.  No weight is dropped, and no list is longer than the number of chunks.
    """
    q, w = 1 - lam, _w(keys)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    x = F.when((F.col("_rn") > k) & F.col(c).isNotNull(), F.col(c).cast("double"))
    df = df.withColumn("_i", F.count(x).over(run))  # known values so far
    df = df.withColumns({"_chunk": F.floor(F.greatest(F.col("_i") - 1, F.lit(0)) / chunk), "_place": F.when(F.col("_i") > 0, F.pmod(F.col("_i") - 1, F.lit(chunk)) + 1).otherwise(0)})
    inside = W.partitionBy(*keys, "_chunk").orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    scaled = F.coalesce(F.sum(lam * x * F.pow(F.lit(q), -F.col("_place"))).over(inside), F.lit(0.0))
    df = df.withColumn("_own", F.pow(F.lit(q), F.col("_place")) * scaled)  # of this chunk up to the row
    full = F.when(x.isNotNull() & (F.col("_place") == chunk), F.struct("_chunk", "_own"))
    before = F.filter(F.collect_list(full).over(run), lambda e: e["_chunk"] < F.col("_chunk"))
    start = F.aggregate(before, F.col(f"_mu_{c}"), lambda z, e: q**chunk * z + e["_own"])
    return df.withColumn(out, F.pow(F.lit(q), F.col("_place")) * start + F.col("_own")).drop("_i", "_chunk", "_place", "_own")


def _ewma_limit(c: str, lam: float, width: float, k: int) -> Column:
    t = F.col("_rn") - k
    sd = F.greatest(F.col(f"_sd_{c}"), F.lit(FLOOR))
    return F.col(f"_mu_{c}") + width * sd * F.sqrt(lam / (2 - lam) * (1 - F.pow(F.lit(1 - lam), 2 * t)))


def _triggers(sigma: float, disagree: float, dip: float) -> Column:
    t1 = F.col("variance") > F.col("_mu_variance") + sigma * F.greatest(F.col("_sd_variance"), F.lit(FLOOR))
    t2, t3 = F.col("disagreement_rate") > disagree, F.col("dip_pvalue") < dip
    return sum((F.coalesce(t, F.lit(False)).cast("int") for t in (t1, t2, t3)), F.lit(0))


def protocol_grid(
    series: DataFrame, keys: Sequence[str] = SERIES, k: int = 3, sigma: float = 2.0, disagree: float = 0.30, dip: float = 0.05,
    needed: Sequence[int] = (1, 2, 3), h: Sequence[float] = (4.0, 5.0), lambdas: Sequence[float] = (0.2, 0.3),
    widths: Sequence[float] = (2.5, 3.0), inds: Sequence[str] = ("variance", "disagreement_rate"), allowance: float = 0.5,
) -> DataFrame:
    """All threshold, CUSUM and EWMA settings in one job with one shuffle on the series key.

    A setting only changes the limit of a shared statistic, so statistics are computed once and the
    settings are an in-row list.
    """
    keys = list(keys)
    df = calibrate(series, sorted({*inds, "variance"}), k, keys)
    rows = []

    def row(name, stat, limit, hit):
        return F.struct(F.lit(name).alias("protocol"), stat.cast("double").alias("statistic"), limit.cast("double").alias("limit"), hit.alias("alarmed"))

    if needed:
        df = df.withColumn("_t", _triggers(sigma, disagree, dip))
        for n in needed:
            rows.append(row({1: "any1", 2: "any2", 3: "all3"}[n], F.col("_t"), F.lit(n), F.col("_t") >= n))
    for c in inds:
        sd = F.greatest(F.col(f"_sd_{c}"), F.lit(FLOOR))
        if h:
            df = _cusum_stat(df, c, keys, allowance * sd, f"_s_{c}", k)
        for x in h:
            rows.append(row(f"cusum_{c}_h{x}", F.col(f"_s_{c}"), x * sd, F.col(f"_s_{c}") > x * sd))
        for i, lam in enumerate(lambdas):
            df = _ewma_stat(df, c, lam, keys, k, f"_z{i}_{c}")
            for width in widths:
                limit = _ewma_limit(c, lam, width, k)
                rows.append(row(f"ewma_{c}_l{lam}_L{width}", F.col(f"_z{i}_{c}"), limit, F.col(f"_z{i}_{c}") > limit))
    keep = [c for c in ("accuracy", "d_star") if c in series.columns]
    return df.where(F.col("_rn") > k).select(*keys, "level", *keep, F.explode(F.array(*rows)).alias("_a")).select(
        *keys, "level", *keep, "_a.*")


def threshold_alarm(series: DataFrame, needed: Sequence[int] = (1, 2, 3), **kw) -> DataFrame:
    return protocol_grid(series, needed=needed, h=(), lambdas=(), **kw)


def cusum_alarm(series: DataFrame, inds: Sequence[str] = ("variance",), h: Sequence[float] = (4.0,), **kw) -> DataFrame:
    return protocol_grid(series, needed=(), h=h, lambdas=(), inds=inds, **kw)


def ewma_alarm(series: DataFrame, inds: Sequence[str] = ("variance",), lambdas: Sequence[float] = (0.2,), widths: Sequence[float] = (2.5,), **kw) -> DataFrame:
    return protocol_grid(series, needed=(), h=(), lambdas=lambdas, widths=widths, inds=inds, **kw)


def plain_cusum(series: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Cumulative sum of variance minus the mean of the first third, alarm above two population stds; under 3 levels none."""
    full, w = W.partitionBy(*keys), _w(keys)
    df = series.withColumns({"_n": F.count(F.lit(1)).over(full), "_rn": F.row_number().over(w)})
    head = F.greatest(F.lit(3), F.floor(F.col("_n") / 3))
    df = df.withColumn("_mu", F.avg(F.when(F.col("_rn") <= head, F.col("variance"))).over(full))
    df = df.withColumn("statistic", F.sum(F.col("variance") - F.col("_mu")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    sd = F.stddev_pop("variance").over(full)
    df = df.withColumn("limit", F.when(sd > 0, 2.0 * sd).otherwise(0.1))
    return df.withColumn("alarmed", (F.col("_n") >= 3) & (F.col("statistic") > F.col("limit"))).select(*keys, "level", "statistic", "limit", "alarmed")


def any_indicator_alarm(series: DataFrame, safe: Column, cols: Sequence[str], keys: Sequence[str] = SERIES) -> DataFrame:
    """Any indicator at or above mean + 1 sample std of the safe rows (thresholds over all series)."""
    safe_value = {c: F.when(safe, F.col(c)) for c in cols}
    limits = series.agg(*[(F.coalesce(F.avg(v) + F.stddev_samp(v), F.lit(1.0))).alias(f"_t_{c}") for c, v in safe_value.items()])
    joined = series.withColumn("_k", F.lit(0)).join(limits.withColumn("_k", F.lit(0)), "_k")
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.col(c) >= F.col(f"_t_{c}"), F.lit(False))
    return joined.select(*keys, "level", hit.alias("alarmed"))


def multi_channel_alarm(series: DataFrame, k: int = 3, keys: Sequence[str] = SERIES) -> DataFrame:
    """First level where variance CUSUM, disagreement CUSUM or a significant dip with raised variance fires; needs k + 1 levels."""
    keys = list(keys)
    df = calibrate(series, ["variance", "disagreement_rate"], k, keys, ddof=0)
    sv = F.greatest(F.col("_sd_variance"), F.col("_mu_variance") * 0.03)
    sd = F.greatest(F.col("_sd_disagreement_rate"), F.lit(0.03))
    df = _cusum_stat(df, "variance", keys, 0.5 * sv, "_sv", k)
    df = _cusum_stat(df, "disagreement_rate", keys, 0.5 * sd, "_sdis", k)
    channel = (
        F.when(F.col("_sv") > 2.5 * sv, "variance")
        .when(F.col("_sdis") > 2.5 * sd, "disagreement")
        .when((F.coalesce("dip_pvalue", F.lit(1.0)) < 0.05) & (F.col("variance") > F.col("_mu_variance") * 1.05), "dip")
    )
    df = df.withColumn("_ch", F.when(F.col("_rn") > k, channel))
    hit = F.when(F.col("_ch").isNotNull(), F.col("level"))
    return df.groupBy(*keys).agg(F.min(hit).alias("alarm_level"), F.min_by("_ch", hit).alias("channel"))


def alarm_metrics(alarms: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Lead time, sensitivity, false-alarm rate, precision, recall and F1 per series and protocol.

    ``alarms`` carries d_star and accuracy; series without a critical level are left out.
    """
    lv, d, hit = F.col("level"), F.col("d_star"), F.col("alarmed")
    near = (lv >= F.greatest(F.lit(1), d - 2)) & (lv <= d)

    def total(c):
        return F.sum(c.cast("long"))

    out = alarms.where(d.isNotNull()).groupBy(*keys, "protocol").agg(
        F.max("d_star").alias("d_star"), F.min(F.when(hit, lv)).alias("d_alarm"),
        F.min_by("accuracy", F.when(hit, lv)).alias("accuracy_at_alarm"),
        F.max((hit & (lv <= d)).cast("int")).alias("sensitivity"),
        F.coalesce(F.avg(F.when(lv < d - 3, hit.cast("double"))), F.lit(0.0)).alias("false_alarm_rate"),
        total(hit & near).alias("tp"), total(hit & ~near).alias("fp"), total(~hit & near).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = out.withColumns({
        "lead_time": F.col("d_star") - F.col("d_alarm"),
        "precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0),
        "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0),
    })
    return out.withColumn("f1", F.when(tp > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0))


def alarm_summary(metrics: DataFrame, prior_f1: float = 0.949) -> DataFrame:
    g = metrics.groupBy("protocol").agg(
        F.coalesce(F.avg("lead_time"), F.lit(0.0)).alias("mean_lead_time"),
        F.avg("sensitivity").alias("mean_sensitivity"), F.avg("false_alarm_rate").alias("mean_false_alarm_rate"),
        F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.avg("f1").alias("macro_f1"),
        F.avg(F.coalesce(F.col("lead_time") > 0, F.lit(False)).cast("double")).alias("lead_positive_share"),
    )
    return g.withColumns({
        "retention": F.col("macro_f1") / prior_f1,
        "readiness": 0.4 * F.col("mean_sensitivity") + 0.3 * (1 - F.col("mean_false_alarm_rate")) + 0.3 * F.col("lead_positive_share"),
    })
