"""Routing between a cheap and a capable model: expected accuracy and cost of policies, replayed over a query table.

Queries are first counted per difficulty, so everything after that first aggregate is level-sized.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from levelscan.operators.joins import nearest_level
from levelscan.plans.session import cut_lineage

COST_CHEAP, COST_CAPABLE = 0.001, 0.010
POLICIES = ("always_cheap", "always_capable", "oracle", "alarm")


def difficulty_counts(queries: DataFrame, keys: Sequence[str], difficulty: str) -> DataFrame:
    return queries.groupBy(*keys, F.col(difficulty).alias("difficulty")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def route(cells: DataFrame, levels: DataFrame, alarms: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    """cells(keys, difficulty, weight) x levels(keys, level, cheap_acc, capable_acc) x alarms(keys, alarm_level), once per policy."""
    keys = list(keys)
    placed = nearest_level(cells, levels, "difficulty", keys).withColumnRenamed("nearest_level", "level")
    joined = placed.join(levels.select(*keys, "level", "cheap_acc", "capable_acc"), [*keys, "level"]).join(alarms, keys, "left")
    capable = {
        "always_cheap": F.lit(False), "always_capable": F.lit(True),
        "oracle": F.col("capable_acc") > F.col("cheap_acc"),
        "alarm": F.coalesce(F.col("difficulty") >= F.col("alarm_level"), F.lit(False)),
    }
    pol = F.array(*[F.struct(F.lit(p).alias("policy"), capable[p].alias("use_capable")) for p in POLICIES])
    rest = [c for c in joined.columns]
    return joined.select(*rest, F.explode(pol).alias("_p")).select(*rest, "_p.*")


def policy_metrics(routed: DataFrame, levels: DataFrame, keys: Sequence[str] = ("task",), batch: int | Sequence[int] = 20, volume: float | None = None) -> DataFrame:
    """Expected accuracy, cost and comparisons per policy (and per batch size, if several are given).

    ``volume``: number of queries the weights stand for (default: their sum).  The alarm policy pays for
    sampling ``batch`` answers at every level up to the alarm (all levels if it never fires).
    """
    keys = list(keys)
    alarm = routed.groupBy(*keys).agg(F.max("alarm_level").alias("_al"))
    seen = levels.join(alarm, keys).groupBy(*keys).agg(F.sum((F.col("_al").isNull() | (F.col("level") <= F.col("_al"))).cast("long")).alias("n_monitored"))
    acc = F.when(F.col("use_capable"), F.col("capable_acc")).otherwise(F.col("cheap_acc"))
    unit = F.when(F.col("use_capable"), COST_CAPABLE).otherwise(COST_CHEAP)
    w = F.col("weight")
    total = F.lit(float(volume)) if volume is not None else F.sum(w)
    g = routed.groupBy(*keys, "policy").agg(
        total.alias("n_queries"), (F.sum(w * acc) / F.sum(w)).alias("accuracy"), (F.sum(w * unit) / F.sum(w) * total).alias("_base"),
        (F.sum(F.when(F.col("use_capable"), w)) / F.sum(w)).alias("_cap"), F.max("alarm_level").alias("alarm_level"),
    ).join(seen, keys)
    sizes = [batch] if isinstance(batch, int) else list(batch)
    g = g.withColumn("batch", F.explode(F.array(*[F.lit(b) for b in sizes])))
    over = F.when(F.col("policy") == "alarm", F.col("n_monitored") * F.col("batch") * COST_CHEAP).otherwise(0.0)
    g = g.withColumns({"overhead": over, "capable_share": F.coalesce("_cap", F.lit(0.0))}).withColumn("total_cost", F.col("_base") + F.col("overhead"))
    full = W.partitionBy(*keys, "batch")

    def of(policy, c):
        return F.max(F.when(F.col("policy") == policy, F.col(c))).over(full)

    g = g.withColumns({"_ca": of("always_cheap", "accuracy"), "_cc": of("always_cheap", "total_cost"), "_kc": of("always_capable", "total_cost"), "_oa": of("oracle", "accuracy")})
    err, cerr = 1 - F.col("accuracy"), 1 - F.col("_ca")
    extra, gap = F.col("total_cost") - F.col("_cc"), F.col("_oa") - F.col("_ca")
    return g.select(
        *keys, *(["batch"] if not isinstance(batch, int) else []), "policy", "accuracy", "total_cost", "overhead", "capable_share", "n_queries", "alarm_level",
        F.when(cerr > 1e-10, (cerr - err) / cerr * 100).otherwise(0.0).alias("error_reduction"),
        (F.col("total_cost") / F.greatest(F.col("_kc"), F.lit(1e-10)) * 100).alias("relative_cost"),
        F.when(extra > 1e-6, (cerr - err) / extra).otherwise(0.0).alias("efficiency"),
        F.when(F.abs(gap) < 1e-10, 0.0).otherwise((F.col("accuracy") - F.col("_ca")) / gap * 100).alias("oracle_gap"),
    )


def pareto_front(points: DataFrame, group: Sequence[str], accuracy: str = "accuracy", cost: str = "total_cost") -> DataFrame:
    """Marks points that no other point beats, by a sweep in cost order instead of comparing all pairs."""
    w = W.partitionBy(*group)
    cheaper = F.max(accuracy).over(w.orderBy(cost).rangeBetween(W.unboundedPreceding, W.currentRow))
    per_cost = F.max(accuracy).over(W.partitionBy(*group, cost))
    out = points.withColumns({"_upto": cheaper, "_same": per_cost})
    first = F.min(cost).over(W.partitionBy(*group, "_upto"))
    # dominated: a better point at the same cost, or the best accuracy so far was reached at a lower cost
    return out.withColumn("_first", first).withColumn(
        "pareto", (F.col(accuracy) == F.col("_same")) & (F.col(accuracy) == F.col("_upto")) & (F.col(cost) == F.col("_first"))
    ).drop("_upto", "_same", "_first")


def break_even(metrics: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    """Queries needed before alarm routing undercuts always-capable; infinite without a saving, at least 1."""
    def of(p, c):
        return F.max(F.when(F.col("policy") == p, c))

    over = of("alarm", F.col("overhead"))
    per = of("alarm", (F.col("total_cost") - F.col("overhead")) / F.col("n_queries"))
    cap = of("always_capable", F.col("total_cost") / F.col("n_queries"))
    out = metrics.groupBy(*keys).agg(over.alias("overhead"), (cap - per).alias("saving"))
    return out.withColumn("break_even", F.when(F.col("saving") <= 1e-10, F.lit(float("inf"))).otherwise(F.greatest(F.col("overhead") / F.col("saving"), F.lit(1.0))))


# cumulative shares of the three difficulty distributions on [0, 1]: uniform, Beta(2, 5), Beta(5, 2)
DISTRIBUTIONS: Mapping[str, object] = {
    "uniform": lambda x: x,
    "beta_easy": lambda x: 1 - F.pow(1 - x, 5) * (1 + 5 * x),
    "beta_hard": lambda x: F.pow(x, 5) * (6 - 5 * x),
}


def distribution_cells(levels: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    """Expected share of every whole difficulty between the lowest and highest level, per distribution."""
    span = levels.groupBy(*keys).agg(F.min("level").alias("_lo"), F.max("level").alias("_hi"))
    d = span.withColumn("difficulty", F.explode(F.sequence("_lo", "_hi")))
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)).cast("double")

    def edge(shift: float) -> Column:
        return F.least(F.greatest((F.col("difficulty") + shift - F.col("_lo")) / width, F.lit(0.0)), F.lit(1.0))

    dist = F.array(*[F.struct(F.lit(n).alias("distribution"), (f(edge(0.5)) - f(edge(-0.5))).alias("weight")) for n, f in DISTRIBUTIONS.items()])
    return d.select(*keys, "difficulty", F.explode(dist).alias("_d")).select(*keys, "difficulty", "_d.*")


def routing_grid(levels: DataFrame, alarms: DataFrame, keys: Sequence[str] = ("task",), batches: Sequence[int] = (10, 15, 20, 30, 50), volume: float = 1000.0) -> DataFrame:
    """task x distribution x batch size x policy; batch only adds overhead, so routing runs once."""
    keys = list(keys)
    levels, alarms = cut_lineage(levels), cut_lineage(alarms)
    cells = distribution_cells(levels, keys)
    dists = F.array(*[F.lit(n) for n in DISTRIBUTIONS])
    lv = levels.withColumn("distribution", F.explode(dists))
    al = alarms.withColumn("distribution", F.explode(dists))
    k = [*keys, "distribution"]
    routed = route(cells, lv, al, k)
    return policy_metrics(routed, lv, k, list(batches), volume)


def method_cost_table(usage: DataFrame, scores: DataFrame, family: str = "family") -> DataFrame:
    """Calls, cost and best F1 per method family."""
    u = usage.groupBy(family).agg(F.count(F.lit(1)).alias("calls"), F.sum("cost").alias("cost"))
    s = scores.groupBy(family).agg(F.max("f1").alias("best_f1"))
    return s.join(u, family, "left").withColumns({"calls": F.coalesce("calls", F.lit(0)), "cost": F.coalesce("cost", F.lit(0.0))})
