"""Analyses of level series: scaling, leading signals, trends, rankings, controls.

Input is a level table with ``d_star``; rows are (series, level), so all of this is small next to the
response rows.  Where several branches read the level table it is checkpointed first, so the response
rows behind it are scanned once.  Several indicators run together as one long (series, level, indicator, value) table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from levelscan.operators import statistics as T
from levelscan.operators.resampling import bootstrap_effect
from levelscan.operators.windows import by_level
from levelscan.plans.session import cut_lineage

SERIES = ("task", "model")

# When an indicator signals, and the direction it should move.
SIGNALS: dict[str, tuple[str, str, float]] = {
    "dip": ("dip_pvalue", "<", 0.05),
    "silhouette": ("silhouette_k2", ">", 0.3),
    "bimodality": ("bimodality_coefficient", ">", 0.555),
    "disagreement": ("disagreement_rate", ">", 0.5),
    "ashman": ("ashman_d", ">", 2.0),
}
TREND_COLUMNS = ("variance", "dip_pvalue", "silhouette_k2", "bimodality_coefficient", "disagreement_rate", "ashman_d")


def long_table(series: DataFrame, cols: Sequence[str] = TREND_COLUMNS, keep: Sequence[str] = (*SERIES, "level", "d_star", "accuracy")) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).cast("double").alias("value")) for c in cols])
    return series.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.*").where(F.col("value").isNotNull())


def signal_flag(name: str) -> Column:
    col, op, limit = SIGNALS[name]
    return F.coalesce(F.col(col) < limit if op == "<" else F.col(col) > limit, F.lit(False))


def variance_scaling(series: DataFrame, keys: Sequence[str] = SERIES, variance_col: str = "variance", floor: float | None = None) -> DataFrame:
    """ln variance on ln(d* - level) below d*, at least three points; exponent, r2 and whether it lies in [-0.7, -0.3]."""
    v = F.col(variance_col)
    v = F.greatest(v, F.lit(floor)) if floor is not None else F.when(v > 0, v)
    pts = series.where(F.col("level") < F.col("d_star")).select(*keys, F.ln(v).alias("_y"), F.ln((F.col("d_star") - F.col("level")).cast("double")).alias("_x"))
    pts = pts.where(F.col("_y").isNotNull())
    out = pts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"), F.regr_slope("_y", "_x").alias("alpha"), F.regr_r2("_y", "_x").alias("r2"))
    ok = F.col("n_points") >= 3
    out = out.withColumns({"alpha": F.when(ok, F.col("alpha")), "r2": F.when(ok, F.col("r2"))})
    return out.withColumn("in_range", F.coalesce(F.col("alpha").between(-0.7, -0.3), F.lit(False)))


def leading_tests(series: DataFrame, keys: Sequence[str] = SERIES, min_accuracy: float = 0.8, names: Sequence[str] = ("dip", "silhouette", "bimodality")) -> DataFrame:
    """Does each signal occur while accuracy is high?  Earliest such level, and consensus of two."""
    good = F.col("accuracy") > min_accuracy
    aggs = []
    for n in names:
        hit = signal_flag(n) & good
        aggs += [F.bool_or(hit).alias(f"{n}_leading"), F.min(F.when(hit, F.col("level"))).alias(f"{n}_level")]
    out = series.groupBy(*keys).agg(*aggs)
    votes = sum((F.col(f"{n}_leading").cast("int") for n in names), F.lit(0))
    return out.withColumns({"consensus": votes >= 2, "first_level": F.least(*[F.col(f"{n}_level") for n in names])})


def leading_trend(series: DataFrame, cols: Sequence[str] = TREND_COLUMNS, keys: Sequence[str] = SERIES, min_accuracy: float = 0.8) -> DataFrame:
    """Trend of each indicator over levels below d* with high accuracy; leading if rising with p < 0.05."""
    pre = long_table(series, cols).where((F.col("level") < F.col("d_star")) & (F.col("accuracy") > min_accuracy))
    k = [*keys, "indicator"]
    t = T.kendall(pre, k, "level", "value").where("n >= 3")
    far = pre.groupBy(*k).agg((F.max("d_star") - F.max("level")).alias("distance"))
    return t.join(far, k).withColumn("leading", (F.col("p_value") < 0.05) & (F.col("tau") > 0))


def lead_time_summary(series: DataFrame, names: Sequence[str] = tuple(SIGNALS), keys: Sequence[str] = SERIES, high: float = 0.8) -> DataFrame:
    """Per series and signal: first level up to d*, lead time, accuracy there, and whether it was still high."""
    flags = F.array(*[F.struct(F.lit(n).alias("indicator"), signal_flag(n).alias("hit")) for n in names])
    pre = series.where(F.col("level") <= F.col("d_star")).select(*keys, "level", "d_star", "accuracy", F.explode(flags).alias("_f")).select(
        *keys, "level", "d_star", "accuracy", "_f.*")
    at = F.when(F.col("hit"), F.col("level"))
    out = pre.groupBy(*keys, "indicator").agg(F.max("d_star").alias("d_star"), F.min(at).alias("d_lead"), F.min_by("accuracy", at).alias("accuracy_at_signal"))
    return out.withColumns({
        "lead_time": F.col("d_star") - F.col("d_lead"),
        "is_leading": F.coalesce(F.col("accuracy_at_signal") > high, F.lit(False)),
    })


def earliest_signal(summary: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """The earliest signal of each series (first name on a tie)."""
    best = F.min_by(F.struct("indicator", "lead_time", "accuracy_at_signal", "is_leading"), F.when(F.col("d_lead").isNotNull(), F.struct("d_lead", "indicator")))
    return summary.groupBy(*keys).agg(F.max("d_star").alias("d_star"), best.alias("_b")).select(*keys, "d_star", "_b.*")


def cross_level_trends(series: DataFrame, cols: Sequence[str] = TREND_COLUMNS, keys: Sequence[str] = SERIES) -> DataFrame:
    return T.kendall(long_table(series, cols), [*keys, "indicator"], "level", "value")


def per_temperature(series: DataFrame, keys: Sequence[str] = ("task", "temperature"), strict: float = 0.8) -> DataFrame:
    """Critical level, strict/relaxed/silhouette lead, scaling, bimodal levels per temperature series.

    ``series`` has d_star (missing ones placed after the last level by the caller).
    """
    keys = list(keys)
    series = cut_lineage(series)
    top = F.max("accuracy").over(W.partitionBy(*keys))
    s = series.withColumn("_relax", F.greatest(F.lit(0.6), 0.7 * top))
    dip, sil = F.col("dip_pvalue") < 0.05, F.col("silhouette_k2") > 0.3
    votes = dip.cast("int") + sil.cast("int") + (F.col("bimodality_coefficient") > 0.555).cast("int")

    def first(c):
        return F.min(F.when(c, F.col("level")))

    out = s.groupBy(*keys).agg(
        F.max("d_star").alias("d_star"), F.max("accuracy").alias("max_accuracy"),
        first(dip & (F.col("accuracy") > strict)).alias("d_lead_strict"),
        first(dip & (F.col("accuracy") > F.col("_relax"))).alias("d_lead_relaxed"),
        first(sil & (F.col("accuracy") > F.col("_relax"))).alias("d_lead_sil"),
        F.sum((votes >= 2).cast("long")).alias("n_bimodal"),
    )
    out = out.withColumns({f"lead_time_{n}": F.col("d_star") - F.col(f"d_lead_{n}") for n in ("strict", "relaxed", "sil")})
    fit = variance_scaling(series, keys).select(*keys, F.col("alpha").alias("scaling_exponent"), F.col("r2").alias("scaling_r2"))
    taus = T.kendall(long_table(series, ("variance", "dip_pvalue", "silhouette_k2", "disagreement_rate"), (*keys, "level")), [*keys, "indicator"], "level", "value")
    wide = taus.groupBy(*keys).agg(*[
        F.max(F.when(F.col("indicator") == c, F.col("tau"))).alias(f"tau_{c}") for c in ("variance", "dip_pvalue", "silhouette_k2", "disagreement_rate")])
    return out.join(fit, keys, "left").join(wide, keys)


def dose_response(series: DataFrame, temps: DataFrame, task: str = "task", cols: Sequence[str] = ("dip_pvalue", "variance", "disagreement_rate")) -> DataFrame:
    """Six checks of how the series change with temperature, and their mean, per task.

    ``series``: level rows with temperature; ``temps``: the result of ``per_temperature``.
    """
    temps = cut_lineage(temps)
    stable = temps.groupBy(task).agg((F.max("d_star") - F.min("d_star")).alias("d_star_range"))
    lead = T.linregress(temps.where(F.col("lead_time_relaxed").isNotNull()), [task], "temperature", "lead_time_relaxed")
    lead = lead.select(task, F.when(F.col("n") >= 3, F.col("slope")).alias("lead_slope"), F.when(F.col("n") >= 3, F.col("p_value")).alias("lead_p"))
    lng = long_table(series, cols, (task, "temperature", "level"))
    rho = T.spearman(lng, [task, "indicator", "level"], "temperature", "value").where("n >= 3")
    share = rho.groupBy(task).agg(*[F.coalesce(F.avg(F.when(F.col("indicator") == c, (F.coalesce("rho", F.lit(0.0)) > 1e-9).cast("double"))), F.lit(0.0)).alias(f"share_{c}") for c in cols])
    zone = T.spearman(temps, [task], "temperature", "n_bimodal").select(task, F.coalesce("rho", F.lit(0.0)).alias("zone_rho"), F.coalesce("p_value", F.lit(1.0)).alias("zone_p"))
    out = stable.join(lead, task, "left").join(share, task, "left").join(zone, task, "left")
    checks = [
        F.col("d_star_range") <= 3,
        (F.col("lead_p") < 0.10) & (F.col("lead_slope") > 0),
        *[F.col(f"share_{c}") > 0.5 for c in cols],
        (F.col("zone_rho") > 0) & (F.col("zone_p") < 0.10),
    ]
    score = sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks), F.lit(0)) / float(len(checks))
    return out.withColumn("evidence_score", score)


def mixture_r2(series: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Pearson r of p(1-p) with variance, and its square (0 if either is flat or under three levels)."""
    mix = series.withColumn("_m", F.col("accuracy") * (1 - F.col("accuracy")))
    ok = (F.count(F.lit(1)) >= 3) & (F.stddev_pop("_m") > 1e-10) & (F.stddev_pop("variance") > 1e-10)
    out = mix.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_levels"), F.when(ok, T.safe_corr("_m", "variance")).alias("r"))
    return out.withColumn("r2", F.coalesce(F.col("r") * F.col("r"), F.lit(0.0)))


def success_criteria(series: DataFrame, f1: float, baseline_f1: float, keys: Sequence[str] = SERIES, high: float = 0.8) -> DataFrame:
    """One row: flicker coverage, mixture fit, classifier gain, and the verdict by their count (series with a d* only)."""
    pos = cut_lineage(series).where(F.col("d_star").isNotNull())
    flick = (F.col("accuracy") > high) & (signal_flag("dip") | signal_flag("silhouette"))
    det = pos.groupBy(*keys).agg(F.bool_or(flick).alias("hit"))
    sc1 = det.agg(
        F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("n_detected"), F.count_distinct(F.when(F.col("hit"), F.col("task"))).alias("n_tasks"),
        F.count_distinct(F.when(F.col("hit"), F.col("model"))).alias("n_models"))
    sc2 = mixture_r2(pos, keys).agg(F.coalesce(F.sum((F.col("r2") > 0.5).cast("long")), F.lit(0)).alias("n_mixture"), F.avg("r2").alias("mean_r2"))
    out = sc1.withColumn("_k", F.lit(0)).join(sc2.withColumn("_k", F.lit(0)), "_k").drop("_k")
    gain = (f1 - baseline_f1) / baseline_f1 * 100 if baseline_f1 > 0 else 0.0
    out = out.withColumns({
        "sc1": (F.col("n_tasks") >= 2) & (F.col("n_models") >= 2), "sc2": F.col("n_mixture") >= 3,
        "gain_pct": F.lit(float(gain)), "sc3": F.lit(gain >= 15.0),
    })
    met = F.col("sc1").cast("int") + F.col("sc2").cast("int") + F.col("sc3").cast("int")
    return out.withColumn("verdict", F.when(met == 3, "confirmed").when(met == 2, "partially confirmed").otherwise("not confirmed"))


def first_signal_levels(series: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """First level below d* where each trend column signals (variance: 1.2 times the previous level)."""
    prev = F.lag("variance").over(by_level(keys))
    s = series.withColumn("_jump", F.coalesce(F.col("variance") > prev * 1.2, F.lit(False)))
    rules = {
        "variance": F.col("_jump"), "dip_pvalue": signal_flag("dip"), "silhouette_k2": signal_flag("silhouette"),
        "bimodality_coefficient": signal_flag("bimodality"), "disagreement_rate": signal_flag("disagreement"), "ashman_d": signal_flag("ashman"),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("indicator"), c.alias("hit")) for n, c in rules.items()])
    pre = s.where(F.col("level") < F.col("d_star")).select(*keys, "level", "d_star", F.explode(pairs).alias("_f")).select(*keys, "level", "d_star", "_f.*")
    return pre.groupBy(*keys, "indicator").agg((F.max("d_star") - F.min(F.when(F.col("hit"), F.col("level")))).alias("lead_time"))


def indicator_ranking(series: DataFrame, expected: Mapping[str, int], keys: Sequence[str] = SERIES) -> DataFrame:
    """Sensitivity on series with d*, specificity on those without, mean lead, mean |tau| and the composite."""
    cols = list(expected)
    keys = list(keys)
    series = cut_lineage(series)
    lng = long_table(series, cols)
    flat = lng.groupBy(*keys, "indicator").agg(
        (F.count(F.lit(1)) >= 4).alias("_n"), (F.stddev_pop("value") >= 1e-10).alias("_s"), F.max("d_star").isNotNull().alias("positive"))
    t = T.kendall(lng, [*keys, "indicator"], "level", "value").join(flat.where("_n and _s"), [*keys, "indicator"])
    direction = F.lit(None).cast("int")
    for c, sign in expected.items():
        direction = F.when(F.col("indicator") == c, sign).otherwise(direction)
    hit = (F.col("p_value") < 0.10) & (F.signum("tau") == direction)
    t = t.join(first_signal_levels(series, keys), [*keys, "indicator"], "left").withColumns({"_hit": hit, "_pos": F.col("positive")})
    pos = F.col("_pos")
    negatives = series.groupBy(*keys).agg(F.max("d_star").isNull().alias("_neg")).agg(F.sum(F.col("_neg").cast("long")).alias("_nneg"))
    out = t.groupBy("indicator").agg(
        (F.sum((pos & F.col("_hit")).cast("long")) / F.greatest(F.sum(pos.cast("long")), F.lit(1))).alias("sensitivity"),
        F.sum((~pos & F.col("_hit")).cast("long")).alias("_miss"),
        F.coalesce(F.avg(F.when(pos, F.col("lead_time"))), F.lit(0.0)).alias("mean_lead_time"),
        F.coalesce(F.avg(F.when(pos, F.abs("tau"))), F.lit(0.0)).alias("mean_effect"),
    ).withColumn("_k", F.lit(0)).join(negatives.withColumn("_k", F.lit(0)), "_k")
    lead = F.least(F.greatest(F.col("mean_lead_time") / 20.0, F.lit(0.0)), F.lit(1.0))
    out = out.withColumn("specificity", 1.0 - F.col("_miss") / F.greatest(F.col("_nneg"), F.lit(1)))
    comp = 0.3 * F.col("sensitivity") + 0.2 * F.col("specificity") + 0.3 * lead + 0.2 * F.least("mean_effect", F.lit(1.0))
    return out.withColumn("composite", comp).select("indicator", "sensitivity", "specificity", "mean_lead_time", "mean_effect", "composite")


def negative_controls(series: DataFrame, cols: Sequence[str] = ("variance", "dip_pvalue"), keys: Sequence[str] = SERIES) -> DataFrame:
    """Trends in series without a critical level: mean |tau|, share significant, false alarms (two or more), verdict."""
    t = T.kendall(long_table(series.where(F.col("d_star").isNull()), cols), [*keys, "indicator"], "level", "value").where("n >= 3")
    per = t.groupBy(*keys).agg(F.avg(F.abs("tau")).alias("a"), F.sum((F.col("p_value") < 0.05).cast("long")).alias("sig"))
    out = per.agg(
        F.count(F.lit(1)).alias("n_series"), F.avg("a").alias("mean_abs_tau"), F.avg((F.col("sig") > 0).cast("double")).alias("share_significant"),
        F.avg((F.col("sig") >= 2).cast("double")).alias("false_alarm_rate"))
    return out.withColumn("passed", F.coalesce((F.col("mean_abs_tau") < 0.3) & (F.col("share_significant") < 0.5), F.lit(False)))


def near_far_control(series: DataFrame, cols: Sequence[str], keys: Sequence[str] = SERIES) -> DataFrame:
    """Per series with d* >= 6: share of indicators larger near d* than far below it (one-sided rank test)."""
    z = F.when(F.col("level") < F.col("d_star") / 2, "far").when(F.col("level").between(F.col("d_star") - 3, F.col("d_star")), "near")
    lng = long_table(series.where("d_star >= 6"), cols).withColumn("_z", z).where(F.col("_z").isNotNull())
    mw = T.mann_whitney(lng, [*keys, "indicator"], "value", "_z", "near", "far").where("n_a >= 1 and n_b >= 2")
    return mw.groupBy(*keys).agg(F.sum((F.col("p_greater") < 0.05).cast("long")).alias("passes"), F.count(F.lit(1)).alias("total")).withColumn(
        "rate", F.col("passes") / F.col("total"))


def consistency_matrix(series: DataFrame, cols: Sequence[str] = TREND_COLUMNS, keys: Sequence[str] = SERIES, limit: float = 0.10) -> DataFrame:
    """Direction -1/0/+1 per series and indicator; flat or short series give 0."""
    lng = long_table(series, cols)
    size = lng.groupBy(*keys, "indicator").agg(F.stddev_pop("value").alias("_s"))
    t = T.kendall(lng, [*keys, "indicator"], "level", "value").join(size, [*keys, "indicator"])
    ok = (F.col("n") >= 4) & (F.col("_s") >= 1e-10) & (F.col("p_value") < limit)
    return t.select(*keys, "indicator", "tau", "p_value", F.when(ok, F.signum("tau").cast("int")).otherwise(0).alias("rating"))


def _near_and_far(series: DataFrame, cols: Sequence[str]) -> DataFrame:
    z = F.when(F.col("level") <= F.col("d_star") - 5, "far").when(F.col("level").between(F.col("d_star") - 3, F.col("d_star")), "near")
    return long_table(cut_lineage(series.where("d_star >= 5")), cols).withColumn("_z", z).where(F.col("_z").isNotNull())


def effect_sizes(series: DataFrame, cols: Sequence[str] = TREND_COLUMNS, keys: Sequence[str] = SERIES) -> DataFrame:
    """Cohen's d and Cliff's delta of near (d*-3..d*) against far (<= d*-5) levels; far needs 3 levels, d* at least 5."""
    lng, k = _near_and_far(series, cols), [*keys, "indicator"]
    d = T.cohens_d(lng, k, "value", "_z", "near", "far").where("n_b >= 3 and n_a >= 1")
    c = T.cliffs_delta(lng, k, "value", "_z", "near", "far")
    return d.select(*k, F.col("n_a").alias("n_near"), F.col("n_b").alias("n_far"), "cohens_d").join(c, k)


def effect_intervals(series: DataFrame, cols: Sequence[str] = TREND_COLUMNS, keys: Sequence[str] = SERIES, b: int = 1000, seed: int = 42) -> DataFrame:
    """Bootstrap interval of each indicator's Cohen's d of near against far levels, both redrawn; same series as ``effect_sizes``."""
    k = [*keys, "indicator"]
    lng = cut_lineage(_near_and_far(series, cols).where(F.col("value").isNotNull()))
    sizes = lng.groupBy(*k).agg(F.count(F.when(F.col("_z") == "near", 1)).alias("n_near"), F.count(F.when(F.col("_z") == "far", 1)).alias("n_far"))
    return bootstrap_effect(lng, k, "value", "_z", "near", "far", ["level"], b, seed).join(sizes.where("n_far >= 3 and n_near >= 1").select(*k), k)


def mean_effects(effects: DataFrame) -> DataFrame:
    return effects.groupBy("indicator").agg(F.coalesce(F.avg("cohens_d"), F.lit(0.0)).alias("mean_d"), F.coalesce(F.avg("cliffs_delta"), F.lit(0.0)).alias("mean_delta"))


def cross_task_consistency(series: DataFrame, keys: Sequence[str] = SERIES, high: float = 0.8) -> DataFrame:
    """Per indicator over series with d*: share leading, Fisher p of the first level below the accuracy mark; mean variance tau."""
    pos = cut_lineage(series.where(F.col("d_star").isNotNull()))
    lead = lead_time_summary(pos, ("dip", "silhouette", "bimodality"), keys, high)
    share = lead.groupBy("indicator").agg(F.avg(F.coalesce(F.col("lead_time") > 0, F.lit(False)).cast("double")).alias("share_leading"))
    at = F.when(F.col("accuracy") < high, F.col("level"))
    one = pos.groupBy(*keys).agg(*[F.min_by(c, at).alias(c) for c in ("dip_pvalue", "silhouette_k2", "bimodality_coefficient")])
    def pseudo(c):
        return F.when(F.col(c) > 0, F.greatest(F.lit(0.001), 1 - F.col(c))).otherwise(1.0)
    pairs = F.array(
        F.struct(F.lit("dip").alias("indicator"), F.col("dip_pvalue").alias("p")), F.struct(F.lit("silhouette").alias("indicator"), pseudo("silhouette_k2").alias("p")),
        F.struct(F.lit("bimodality").alias("indicator"), pseudo("bimodality_coefficient").alias("p")))
    ps = one.where(F.col("dip_pvalue").isNotNull()).select(F.explode(pairs).alias("_p")).select("_p.*").where("p > 0")
    fisher = T.fisher_combine(ps, ["indicator"], "p").select("indicator", "p_combined")
    pre = pos.where(F.col("level") <= F.col("d_star"))
    tau = T.kendall(pre, list(keys), "level", "variance", p_value=False).where("n >= 3").agg(
        F.avg("tau").alias("mean_tau"), F.avg((F.col("tau") > 0).cast("double")).alias("share_positive_tau"))
    return share.join(fisher, "indicator", "left").withColumn("_k", F.lit(0)).join(tau.withColumn("_k", F.lit(0)), "_k").drop("_k")


def detection_power(series: DataFrame, sizes: Sequence[int] = (10, 15, 20, 25, 30, 40, 50), base: int = 50) -> DataFrame:
    """Near-zone dip detection rate scaled by (N/base)^0.3, capped at 1."""
    near = series.where("d_star >= 5").where(F.col("level").between(F.col("d_star") - 3, F.col("d_star")))
    rate = near.agg(F.coalesce(F.avg((F.col("dip_pvalue") < 0.05).cast("double")), F.lit(0.0)).alias("_r"))
    out = rate.withColumn("n", F.explode(F.array(*[F.lit(n) for n in sizes])))
    return out.select("n", F.least(F.lit(1.0), F.col("_r") * F.pow(F.col("n") / float(base), 0.3)).alias("power"))
