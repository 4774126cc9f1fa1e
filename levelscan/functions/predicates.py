"""Column expressions over level-series rows: names, labels, zones, flags."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def short_name(model: Column | str, names: Mapping[str, str] | None = None) -> Column:
    """Display name from a lookup, else the text after the last '/'."""
    m = _c(model)
    tail = F.element_at(F.split(m, "/"), -1)
    if not names:
        return tail
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, m), tail)


def pair_id(task: Column | str, model: Column | str) -> Column:
    return F.concat_ws("__", _c(task), _c(model))


def label_near(level: Column | str, d_star: Column | str, k: int = 2, mode: str = "approaching") -> Column:
    """1 near the critical level, 0 away from it, NULL where there is no critical level (or in the gap)."""
    lv, d = _c(level), _c(d_star)
    if mode == "approaching":
        hit = lv >= d - k
    elif mode == "symmetric":
        hit = F.abs(lv - d) <= k
    elif mode == "one_sided":
        hit = (d - lv <= k) & (lv <= d)
    elif mode == "gap":
        return F.when(lv >= d - k, 1).when(lv <= d - k - 1, 0)
    else:
        raise ValueError(mode)
    return hit.cast("int")


def zone(level: Column | str, d_star: Column | str, pre: int = 3, far: int = 5) -> Column:
    """far / pre / near / beyond, relative to the critical level."""
    lv, d = _c(level), _c(d_star)
    return (
        F.when((lv <= d - far) | (lv < d / 2.0), "far")
        .when(lv < d - pre, "pre")
        .when(lv <= d, "near")
        .when(lv > d, "beyond")
    )


def classify_pairs(series: DataFrame, keys=("task", "model"), d_star: str = "d_star", inverted: str | None = None) -> DataFrame:
    """positive / negative / excluded per series."""
    aggs = [F.min("level").alias("min_level"), F.max(d_star).alias("d_star")]
    rule = F.when(F.col("d_star").isNull(), "negative")
    if inverted:
        aggs.append(F.max(inverted).alias("_inv"))
        rule = rule.when(F.col("_inv"), "negative")
    out = series.groupBy(*keys).agg(*aggs)
    return out.withColumn(
        "pair_class", rule.when(F.col("d_star") > F.col("min_level"), "positive").otherwise("excluded")
    ).drop("_inv")


def task_indicators(task: Column | str, tasks) -> dict[str, Column]:
    return {f"is_{t}": (_c(task) == t).cast("double") for t in tasks}


def safe_float(x: Column | str, default: float = 0.0) -> Column:
    """Number from text; anything missing, non-numeric or non-finite becomes the default."""
    v = _c(x).cast("string").try_cast("double") if hasattr(Column, "try_cast") else F.expr(f"try_cast({x} as double)")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(v)


def binary_indicators(series_keys=("task", "model")) -> dict[str, Column]:
    prev = F.lag("variance").over(W.partitionBy(*series_keys).orderBy("level"))
    return {
        "b_dip": (F.col("dip_pvalue") < 0.05).cast("int"),
        "b_silhouette": (F.col("silhouette_k2") > 0.3).cast("int"),
        "b_bimodality": (F.col("bimodality_coefficient") > 0.555).cast("int"),
        "b_disagreement": (F.col("disagreement_rate") > 0.5).cast("int"),
        "b_variance_up": F.coalesce((F.col("variance") - prev > 0).cast("int"), F.lit(0)),
    }


def bimodality_consensus(bc_limit: float = 5.0 / 9.0, needed: int = 2) -> Column:
    votes = [
        F.col("dip_pvalue") < 0.05,
        F.col("silhouette_k2") > 0.3,
        F.col("bimodality_coefficient") > bc_limit,
    ]
    total = sum((F.coalesce(v, F.lit(False)).cast("int") for v in votes), F.lit(0))
    return total >= needed


def short_answer(answer: Column | str) -> Column:
    a = _c(answer)
    n = F.size(F.filter(F.split(a, r"\s+"), lambda t: t != ""))
    return (n >= 1) & (n <= 5) & (F.length(a) < 100)


def variant_category(name: Column | str) -> Column:
    n = _c(name)
    return F.when(n.contains("spuq"), "spuq").when(n.contains("only") | n.contains("random"), "baseline").otherwise("csd")


def token_cost(usage: DataFrame, prices: DataFrame, key: str = "model") -> DataFrame:
    """usage(model, tokens_in, tokens_out) x prices(model, price_in, price_out) per million tokens.

    The price table is joined by equality; Spark broadcasts it when its size allows.
    """
    return usage.join(prices, key, "left").withColumn(
        "cost", (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    )
