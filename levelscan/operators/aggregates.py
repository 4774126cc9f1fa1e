"""Grouped aggregates over response rows.

Two-level counts (per answer, then per group) keep a hot group split over its answers and
combine on the map side, so no group is ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from levelscan.plans.session import cut_lineage

KEYS = ("task", "model", "level")


def bimodality(skew: Column, kurt: Column, n: Column) -> Column:
    """(skew^2 + 1) / (excess kurtosis + 3(n-1)^2/((n-2)(n-3))), 0 for fewer than four rows or a flat group."""
    corr = 3.0 * F.pow(n - 1, 2) / ((n - 2) * (n - 3)).cast("double")
    bc = (F.pow(skew, 2) + 1) / (kurt + corr)
    return F.when((n < 4) | skew.isNull() | F.isnan(skew), F.lit(0.0)).otherwise(bc)


def ashman_labels(x: str = "x", correct: str = "correct") -> Column:
    """Separation of correct and incorrect rows; NULL unless both sides have two rows."""
    good, bad = F.when(F.col(correct), F.col(x)), F.when(~F.col(correct), F.col(x))
    gap = F.sqrt(F.lit(2.0)) * F.abs(F.avg(good) - F.avg(bad))
    spread = F.sqrt(F.var_pop(good) + F.var_pop(bad))
    return F.when((F.count(good) >= 2) & (F.count(bad) >= 2) & (spread > 0), gap / spread)


def level_table(rows: DataFrame, keys: Sequence[str] = KEYS, x: str = "x", modes: bool = True) -> DataFrame:
    """Level series: one row of indicators per series and level.

    With ``modes`` also ``dip_pvalue`` and ``silhouette_k2`` of the rows' values (see indicators.modality): whether a cell has two modes.
    """
    keys = list(keys)
    if modes:
        return _level_table_with_modes(rows, keys, x)
    v = F.col(x)
    moments = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"),
        F.skewness(v).alias("_skew"),
        F.kurtosis(v).alias("_kurt"),
        ashman_labels(x).alias("ashman_d"),
    )
    moments = moments.withColumn(
        "bimodality_coefficient", bimodality(F.col("_skew"), F.col("_kurt"), F.col("n"))
    ).drop("_skew", "_kurt")
    return moments.join(disagreement(rows, keys, policy="all"), keys)


def _level_table_with_modes(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Moments and modes both follow from the counts of each cell's distinct values, so the rows are read once for them."""
    from levelscan.operators.indicators import modality_of_counts

    cells = cut_lineage(rows.groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(
        F.count(F.lit(1)).alias("_c"), F.count("correct").alias("_known"), F.count_if("correct").alias("_good")))
    centres = cut_lineage(_centres_of_counts(cells, keys))
    out = _moments_of_counts(cells, keys, centres).join(disagreement(rows, keys, policy="all"), keys)
    return out.join(modality_of_counts(cells, keys, sizes=centres).drop("dip_statistic"), keys, "left")


def _sides() -> dict[str, Column]:
    """Weights of a distinct value: its rows, its correct rows, its incorrect rows."""
    return {"all": F.col("_c"), "good": F.col("_good"), "bad": F.col("_known") - F.col("_good")}


def _centres_of_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: rows, accuracy, distinct values, and the number and mean of the values of each side; equal values are their own mean."""
    v = F.col("_x")
    aggs = [F.sum("_c").alias("n"), F.sum("_good").alias("_ok"), F.sum("_known").alias("_judged"), F.count(v).alias("_k")]
    for s, w in _sides().items():
        has = v.isNotNull() & (w > 0)
        lo, hi, total = F.min(F.when(has, v)), F.max(F.when(has, v)), F.sum(F.when(has, w))
        aggs += [F.coalesce(total, F.lit(0)).alias(f"_n_{s}"), F.when(lo == hi, lo).otherwise(F.sum(F.when(has, w * v)) / total).alias(f"_mean_{s}")]
    out = cells.groupBy(*keys).agg(*aggs)
    return out.withColumn("accuracy", F.when(F.col("_judged") > 0, F.col("_ok") / F.col("_judged"))).drop("_ok", "_judged")


def _moments_of_counts(cells: DataFrame, keys: list[str], centres: DataFrame) -> DataFrame:
    """The columns of ``level_table`` that are moments, from sums of powers about the means."""
    d = F.col("_x") - F.col("_mean_all")
    apart = {s: F.col("_x") - F.col(f"_mean_{s}") for s in ("good", "bad")}
    sums = cells.where(F.col("_x").isNotNull()).join(centres.select(*keys, *[f"_mean_{s}" for s in _sides()]), keys).groupBy(*keys).agg(
        F.sum(F.col("_c") * d * d).alias("_m2"), F.sum(F.col("_c") * d * d * d).alias("_m3"), F.sum(F.col("_c") * d * d * d * d).alias("_m4"),
        *[F.sum(w * apart[s] * apart[s]).alias(f"_m2_{s}") for s, w in _sides().items() if s in apart])
    n, m2 = F.col("_n_all"), F.col("_m2")
    skew = F.when(m2 > 0, F.sqrt(n) * F.col("_m3") / F.pow(m2, 1.5))
    kurt = F.when(m2 > 0, n * F.col("_m4") / (m2 * m2) - 3)
    gap = F.sqrt(F.lit(2.0)) * F.abs(F.col("_mean_good") - F.col("_mean_bad"))
    two = (F.col("_n_good") >= 2) & (F.col("_n_bad") >= 2)
    spread = F.when(two, F.sqrt(F.col("_m2_good") / F.col("_n_good") + F.col("_m2_bad") / F.col("_n_bad")))
    return centres.join(sums, keys, "left").select(
        *keys, "n", "accuracy", F.coalesce(F.when(n > 1, m2 / (n - 1)), F.lit(0.0)).alias("variance"),
        F.when(two & (spread > 0), gap / spread).alias("ashman_d"), bimodality(skew, kurt, F.col("n")).alias("bimodality_coefficient"))


def accuracy(rows: DataFrame, keys: Sequence[str], den: str = "all") -> DataFrame:
    """``den``: 'extracted' (parsed answers with a usable truth), 'all', or 'valid' (usable vector)."""
    if den == "extracted":
        ok = F.col("answer").isNotNull() & F.col("truth").isNotNull()
        hits = F.sum((ok & (F.col("answer") == F.col("truth"))).cast("long"))
        acc = hits / F.greatest(F.sum(ok.cast("long")), F.lit(1))
    elif den == "all":
        acc = F.avg(F.coalesce(F.col("correct"), F.lit(False)).cast("double"))
    elif den == "valid":
        rows = rows.where(F.col("norm") > 1e-8)
        acc = F.avg(F.col("correct").cast("double"))
    else:
        raise ValueError(den)
    return rows.groupBy(*keys).agg(acc.alias("accuracy"))


def answer_counts(rows: DataFrame, keys: Sequence[str], answer: str | Column = "answer") -> DataFrame:
    a = F.col(answer) if isinstance(answer, str) else answer
    return rows.groupBy(*keys, a.alias("answer")).agg(F.count(F.lit(1)).alias("c"))


def disagreement(rows: DataFrame, keys: Sequence[str], policy: str = "all") -> DataFrame:
    """1 - share of the most frequent answer.

    extracted: among parsed answers, 1.0 if none; all: an unparsed answer counts as its own answer;
    normalized: lower/trim non-blank answers over all rows; boolean: TRUE/FALSE answers only.
    """
    counted = answer_counts(rows, keys)
    c, total = F.col("c"), F.sum("c")
    if policy == "all":
        rate = 1 - F.max("c") / total
    elif policy == "extracted":
        parsed = F.when(F.col("answer").isNotNull(), c)
        rate = F.coalesce(1 - F.max(parsed) / F.sum(parsed), F.lit(1.0))
    elif policy == "normalized":
        counted = answer_counts(rows, keys, F.lower(F.trim(F.col("answer"))))
        rate = 1 - F.coalesce(F.max(F.when(F.col("answer") != "", c)), F.lit(0)) / total
    elif policy == "boolean":
        tf = F.when(F.col("answer").isin("TRUE", "FALSE"), c)
        rate = F.coalesce(1 - F.max(tf) / F.sum(tf), F.lit(1.0))
    else:
        raise ValueError(policy)
    return counted.groupBy(*keys).agg(rate.alias("disagreement_rate"))


def majority_answer(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Most frequent answer; a tie goes to the answer seen first in ``order``."""
    counted = rows.where(F.col("answer").isNotNull()).groupBy(*keys, "answer").agg(
        F.count(F.lit(1)).alias("c"), F.min(order).alias("first_seen")
    )
    return counted.groupBy(*keys).agg(
        F.max_by("answer", F.struct(F.col("c"), -F.col("first_seen"))).alias("majority_answer"),
        F.max("c").alias("majority_count"),
    )


def answer_balance(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    t = F.sum((F.col("answer") == "TRUE").cast("long"))
    f = F.sum((F.col("answer") == "FALSE").cast("long"))
    return rows.groupBy(*keys).agg((F.least(t, f) / F.greatest(t + f, F.lit(1))).alias("answer_balance"))


def answer_entropy(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base-2 entropy from counts: log2(N) - sum(c log2 c)/N, one pass over the count table."""
    counted = answer_counts(rows.where(F.col("answer").isNotNull()), keys)
    n = F.sum("c")
    ent = F.log2(n) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / n
    return counted.groupBy(*keys).agg(ent.alias("answer_entropy"))


def answer_quality(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    counted = answer_counts(rows, keys)
    parsed = F.when(F.col("answer").isNotNull(), F.col("c")).otherwise(F.lit(0))
    return counted.groupBy(*keys).agg(
        F.count("answer").alias("unique_answers"),
        (F.sum(parsed) / F.sum("c")).alias("extraction_rate"),
        F.sum(parsed).alias("n_parsed"),
        (F.sum("c") - F.sum(parsed)).alias("n_extraction_failures"),
    )


def group_counts(items: DataFrame, keys: Sequence[str], near: Column | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if near is not None:
        aggs += [F.sum((near == 1).cast("long")).alias("n_near"), F.sum((near == 0).cast("long")).alias("n_safe")]
    return items.groupBy(*keys).agg(*aggs)


def _equals(symbol: str):
    return lambda o: o == symbol


def op_distribution(items: DataFrame, level: str, ops: str, symbols: Sequence[str]) -> DataFrame:
    """Share of each operator symbol of an array column per level.

    Counted inside each row's array, so nothing is exploded or shuffled but the per-level sums.
    """
    total = F.sum(F.size(ops))
    return items.groupBy(level).agg(
        *[
            (F.sum(F.size(F.filter(F.col(ops), _equals(s)))) / total).alias(f"share_{i}")
            for i, s in enumerate(symbols)
        ]
    )


def value_summary(items: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """Min, max and mean over an array column (or a scalar), per group."""
    col = F.col(values)
    if dict(items.dtypes)[values].startswith("array"):
        n, s = F.size(col), F.aggregate(col, F.lit(0.0), lambda a, b: a + b)
        lo, hi = F.array_min(col), F.array_max(col)
    else:
        n, s, lo, hi = F.lit(1), col.cast("double"), col, col
    return items.groupBy(*keys).agg(
        F.min(lo).alias("min_value"), F.max(hi).alias("max_value"), (F.sum(s) / F.sum(n)).alias("mean_value")
    )


def macro_average(metrics: DataFrame, method: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return metrics.groupBy(*method).agg(*[F.avg(c).alias(f"macro_{c}") for c in cols])


def win_counts(scores: DataFrame, series: Sequence[str], model: str, score: str, lower: bool = True) -> DataFrame:
    """How many series each model wins by the smallest (or largest) score; ties go to the first name."""
    s = F.col(score) if lower else -F.col(score)
    best = scores.where(F.col(score).isNotNull()).groupBy(*series).agg(
        F.min_by(F.col(model), F.struct(s, F.col(model))).alias("winner")
    )
    return best.groupBy("winner").agg(F.count(F.lit(1)).alias("wins"))


def significance_summary(tests: DataFrame, keys: Sequence[str], p: str, rho: str, limit: float = 0.05) -> DataFrame:
    return tests.groupBy(*keys).agg(
        F.bool_and(F.col(p) < limit).alias("all_significant"),
        F.avg((F.col(rho) > 0).cast("double")).alias("fraction_positive"),
    )


def coverage_count(series: DataFrame, signal: Column, need_tasks: int = 2, need_models: int = 2) -> DataFrame:
    t = F.count_distinct(F.when(signal, F.col("task")))
    m = F.count_distinct(F.when(signal, F.col("model")))
    out = series.agg(t.alias("n_tasks"), m.alias("n_models"))
    return out.withColumn("passed", (F.col("n_tasks") >= need_tasks) & (F.col("n_models") >= need_models))


def cv_dispersion(series: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    return series.groupBy(*keys).agg(
        F.avg(col).alias("mean_value"),
        F.stddev_pop(col).alias("std_value"),
        (F.stddev_pop(col) / F.avg(col)).alias("cv"),
    )


def usage_totals(usage: DataFrame, key: str) -> DataFrame:
    """Calls, tokens and cost by model, and in total (the row with a NULL model)."""
    return usage.rollup(key).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost").alias("cost"),
    )


def problem_then_level_mean(rows: DataFrame, level_keys: Sequence[str], item: str) -> DataFrame:
    """Disagreement and accuracy per item over its paraphrases (one answer only: 1.0), then the mean per level."""
    counted = rows.groupBy(*level_keys, item, "answer").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.col("correct").cast("long")).alias("ok")
    )
    parsed = F.when(F.col("answer").isNotNull(), F.col("c"))
    per_item = counted.groupBy(*level_keys, item).agg(
        F.when(F.coalesce(F.sum(parsed), F.lit(0)) >= 2, 1 - F.max(parsed) / F.sum(parsed)).otherwise(1.0).alias("d"),
        (F.sum("ok") / F.sum("c")).alias("a"),
    )
    return per_item.groupBy(*level_keys).agg(
        F.avg("d").alias("mean_disagreement"), F.avg("a").alias("mean_accuracy"), F.count(F.lit(1)).alias("n_items")
    )
