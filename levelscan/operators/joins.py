"""Joins between response, item, level and lookup tables.  All are equality joins.

Small sides (levels of a series, lookups) carry no broadcast hint: Spark broadcasts them when the
measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from levelscan.operators.vectors import group_pair_stats

KEYS = ("task", "model", "level")


def attach_baseline(levels: DataFrame, baseline: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Left join of a level-table baseline; a gap takes the column median (0.5 if the column is empty)."""
    joined = levels.join(baseline.select(*keys, *cols), list(keys), "left")
    everything = W.partitionBy(F.lit(0))
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.percentile(c, 0.5).over(everything), F.lit(0.5)) for c in cols}
    )


def attach_d_star(levels: DataFrame, model_meta: DataFrame, on: Sequence[str] = ("model",)) -> DataFrame:
    return levels.join(model_meta.select(*on, "d_star"), list(on), "left")


def score(responses: DataFrame, items: DataFrame, on: Sequence[str], answer: str = "answer", truth: str = "truth") -> DataFrame:
    """Join to the ground truth and compare; an unparsed answer is wrong."""
    hit = F.coalesce(F.col(answer) == F.col(truth), F.lit(False))
    return responses.join(items, list(on)).withColumn("correct", hit)


def check_colouring(edges: DataFrame, colours: DataFrame, instance: str, strict: bool = True) -> DataFrame:
    """Violated edges per instance.

    edges(instance, u, v), colours(instance, node, colour).  Strict: every end needs a colour;
    lenient: an edge with an uncoloured end is ignored.
    """
    cu = colours.select(instance, F.col("node").alias("u"), F.col("colour").alias("cu"))
    cv = colours.select(instance, F.col("node").alias("v"), F.col("colour").alias("cv"))
    e = edges.join(cu, [instance, "u"], "left").join(cv, [instance, "v"], "left")
    clash = F.coalesce(F.col("cu") == F.col("cv"), F.lit(False))
    missing = F.col("cu").isNull() | F.col("cv").isNull()
    bad = clash | missing if strict else clash
    return e.groupBy(instance).agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.sum(clash.cast("long")).alias("n_violated"),
        (~F.bool_or(bad)).alias("valid"),
    )


def _norm(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def extend_chains(chains: DataFrame, facts: DataFrame, excluded: int = 1) -> DataFrame:
    """Add one hop: the chain's last answer is the entity of a fact from another source; first fact wins.

    chains(chain_id, source, answer, path), facts(fact_id, source, entity, answer).  The sources of the last ``excluded``
    hops can't come again; with more than one, the chain carries them in ``used``, latest last.  Only the
    ``excluded`` + 1 first facts of distinct sources per entity can ever be chosen, so the join partner list
    is no longer than that whatever the skew.
    """
    per_source = facts.groupBy(_norm("entity").alias("entity"), "source").agg(
        F.min(F.struct("fact_id", "answer")).alias("f")
    )
    rank = F.row_number().over(W.partitionBy("entity").orderBy("f.fact_id"))
    first = per_source.withColumn("_r", rank).where(F.col("_r") <= excluded + 1)
    packed = first.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("_r", "source", "f"))).alias("_facts"))
    used = F.col("used") if "used" in chains.columns else F.array("source")
    joined = chains.withColumn("_used", used).withColumn("entity", _norm("answer")).join(packed, "entity")
    free = F.filter("_facts", lambda x: ~F.array_contains("_used", x["source"]))
    carried = F.array_append("_used", F.col("_n.source"))
    latest = [F.slice(carried, -F.least(F.size(carried), F.lit(excluded)), F.lit(excluded)).alias("used")] if excluded > 1 else []
    return joined.withColumn("_n", F.get(free, 0)).where(F.col("_n").isNotNull()).select(
        "chain_id",
        F.col("_n.source").alias("source"),
        F.col("_n.f.answer").alias("answer"),
        F.array_append("path", F.col("_n.f.fact_id")).alias("path"),
        *latest,
    )


def nearest_level(queries: DataFrame, levels: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Nearest available level of the series, the lower one on a tie.

    The distinct levels of a series travel as one short sorted array on an equality join.
    """
    per_series = levels.groupBy(*keys).agg(F.sort_array(F.collect_set("level")).alias("_levels"))
    best = F.array_min(F.transform("_levels", lambda l: F.struct(F.abs(l - F.col(value)).alias("gap"), l.alias("level"))))
    return queries.join(per_series, list(keys)).withColumn("nearest_level", best["level"]).drop("_levels")


def within_group_pairs(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Pair statistics of a group from group sums; pairs are never listed."""
    return group_pair_stats(df, keys, vector)


def substrings(c: Column) -> Column:
    """All distinct substrings of a short key."""
    n = F.length(c)
    return F.array_distinct(
        F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda l: F.substring(c, i, l))))
    )


def tolerance_match(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Grade claims(claim_id, key, value, tol) against sources(key, source_value).

    Within tol VERIFIED, within 3 tol ROUNDING, else MISMATCH (CRITICAL above 0.05), no source UNSOURCED.
    A claim without an exact key falls back to the first source key that contains it; the containment
    test is an equality join on the substrings of the source keys of unmatched claims.
    """
    exact = claims.join(sources, "key", "left")
    hit = exact.where(F.col("source_value").isNotNull())
    rest = exact.where(F.col("source_value").isNull()).drop("source_value")
    wanted = rest.select("key").distinct()
    exploded = sources.select(F.explode(substrings(F.col("key"))).alias("sub"), F.col("key").alias("source_key"), "source_value")
    found = (
        exploded.join(wanted.withColumnRenamed("key", "sub"), "sub")
        .groupBy("sub")
        .agg(F.min_by("source_value", "source_key").alias("source_value"))
        .withColumnRenamed("sub", "key")
    )
    graded = hit.unionByName(rest.join(found, "key", "left"))
    delta = F.abs(F.col("value") - F.col("source_value"))
    status = (
        F.when(F.col("source_value").isNull(), "UNSOURCED")
        .when(delta <= F.col("tol"), "VERIFIED")
        .when(delta <= F.col("tol") * 3, "ROUNDING")
        .when(delta > 0.05, "CRITICAL")
        .otherwise("MINOR")
    )
    return graded.select("claim_id", "key", "value", "source_value", delta.alias("delta"), status.alias("status"))


def unresolved_keys(docs: DataFrame, refs: DataFrame, cites: Column, doc_id: str) -> DataFrame:
    """Citation keys without an entry, with the number of citing documents."""
    keys = docs.select(doc_id, F.explode(cites).alias("key")).distinct()
    return keys.join(refs.select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))


def resolved_count(docs: DataFrame, refs: DataFrame, cites: Column) -> DataFrame:
    keys = docs.select(F.explode(cites).alias("key")).distinct()
    found = refs.select("key").distinct().withColumn("_hit", F.lit(1))
    return keys.join(found, "key", "left").agg(
        F.count(F.lit(1)).alias("n_keys"), F.count("_hit").alias("n_resolved")
    )


def grid_cross(df: DataFrame, **grids: Sequence[float]) -> DataFrame:
    """Every row with every combination of a few literal parameter values (an in-row explode)."""
    for name, values in grids.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return df


def common_levels(a: DataFrame, b: DataFrame, how: str = "intersect") -> DataFrame:
    la, lb = a.select("level").distinct(), b.select("level").distinct()
    if how == "intersect":
        return la.join(lb, "level")
    return la.union(lb).distinct()


def model_task_matrix(rows: DataFrame, model: str = "model", task: str = "task") -> DataFrame:
    """Models seen in more than one task."""
    return rows.select(model, task).distinct().groupBy(model).agg(F.count(F.lit(1)).alias("n_tasks")).where("n_tasks > 1")
