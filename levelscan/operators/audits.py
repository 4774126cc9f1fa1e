"""Audit of numeric claims in text, and validation of item tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from levelscan.plans.session import cut_lineage

ELIGIBLE = ("f1_score", "auroc", "improvement_pct", "percentage")

# Three ways an estimate and its interval are written.
CI_PATTERNS = (
    r"(\d+\.\d+)\s*\[(\d+\.\d+),\s*(\d+\.\d+)\]",
    r"(\d+\.?\d*)\\?%\s*\[(\d+\.?\d*)\\?%?,\s*(\d+\.?\d*)\\?%?\]",
    r"F1.*?(\d+\.\d+).*?\[(\d+\.\d+),\s*(\d+\.\d+)\]",
)


def stale_values(claims: DataFrame, stale: Mapping[str, str], doc: str = "doc_id") -> DataFrame:
    """Claims that contain a known outdated value; once per (document, value, line).

    The outdated values are a short literal list checked inside the row.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("stale_value"), F.lit(v).alias("correct_value")) for k, v in stale.items()])
    hits = claims.where(F.col("value_type").isin(*ELIGIBLE)).withColumn(
        "_s", F.explode(F.filter(pairs, lambda s: F.contains(F.col("value"), s["stale_value"])))
    )
    return hits.select(doc, "line_no", "_s.*").distinct()


def interval_checks(lines: DataFrame, line: str = "line") -> DataFrame:
    """Estimates with an interval that does not hold: order, containment (0.005 slack), width."""
    found = []
    for p in CI_PATTERNS:
        g = [F.transform(F.regexp_extract_all(line, F.lit(p), F.lit(i)), lambda s: s.try_cast("double")) for i in (1, 2, 3)]
        found.append(F.arrays_zip(g[0].alias("point"), g[1].alias("lower"), g[2].alias("upper")))
    rows = lines.where(F.contains(F.col(line), F.lit("["))).withColumn("_c", F.explode(F.concat(*found)))
    rows = rows.select(*[c for c in lines.columns if c != line], "_c.*")
    point, lo, hi = F.col("point"), F.col("lower"), F.col("upper")
    issues = F.concat_ws(
        "; ",
        F.when(lo > hi, "ci_lower > ci_upper"),
        F.when(point < lo - 0.005, "point_estimate < ci_lower"),
        F.when(point > hi + 0.005, "point_estimate > ci_upper"),
        F.when(hi - lo < 0, "negative_ci_width"),
    )
    return rows.withColumn("issues", issues)


def ci_anomalies(lines: DataFrame, line: str = "line", doc: str = "doc_id") -> DataFrame:
    """Distinct broken (point, lower, upper) triples per document with the first line they occur on."""
    bad = interval_checks(lines, line).where(F.col("issues") != "")
    return bad.groupBy(doc, "point", "lower", "upper", "issues").agg(F.min("line_no").alias("line_no"))


def derived_value_check(df: DataFrame, kind: str, a: Column, b: Column, stated: Column, tol: float) -> DataFrame:
    """Stated gain (a-b)/b*100, or harmonic mean 2ab/(a+b), against the recomputed value."""
    expected = (a - b) / b * 100 if kind == "gain" else F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)
    return df.withColumns({"expected": expected, "delta": F.abs(stated - expected), "is_error": F.abs(stated - expected) > tol})


def inconsistent_quantities(claims: DataFrame, quantity: Sequence[str], value: str = "value") -> DataFrame:
    """Quantities stated with more than one value; occurrences are counted per value, not listed."""
    per_value = claims.groupBy(*quantity, value).agg(F.count(F.lit(1)).alias("c"))
    out = per_value.groupBy(*quantity).agg(
        F.count(F.lit(1)).alias("n_values"), F.sum("c").alias("n_claims"),
        F.min(value).alias("first_value"), F.max(value).alias("last_value"),
    )
    return out.where("n_values > 1")


def integrity_summary(graded: DataFrame, status: str = "status") -> DataFrame:
    s = F.col(status)
    out = graded.agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.sum((s == k).cast("long")).alias(k.lower()) for k in ("VERIFIED", "ROUNDING", "MINOR", "CRITICAL", "UNSOURCED")],
    )
    score = F.when(F.col("checked") > 0, F.col("verified") / F.col("checked")).otherwise(0.0)
    return out.withColumns({"score": score, "ready": (F.col("critical") == 0) & (score >= 0.9)})


def source_registry(df: DataFrame, file: str, metrics: str) -> DataFrame:
    """Nested metric maps (group -> name -> value) to key, value, file, path."""
    one = df.select(file, F.explode(metrics).alias("_g", "_m"))
    two = one.select(file, "_g", F.explode("_m").alias("_k", "value"))
    return two.select(
        F.concat_ws("_", "_g", "_k").alias("key"), F.col("value").cast("double").alias("value"), F.col(file).alias("source_file"),
        F.concat_ws(".", F.lit("metrics"), "_g", "_k").alias("source_path"),
    )


def validate_items(
    df: DataFrame, rules: Mapping[str, Column], id_col: str, text_col: str | None = None, level_col: str | None = None, per_level: int | None = None
) -> DataFrame:
    """One row per rule with its number of violations.

    Row rules are one pass; duplicates and level counts come from map-side combined group counts.
    """
    row = df.agg(*[F.coalesce(F.sum((~F.coalesce(c, F.lit(False))).cast("long")), F.lit(0)).alias(n) for n, c in rules.items()])
    parts = [row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("_r")).select("_r.*")]

    def dup(name, key):
        c = df.groupBy(key.alias("_k")).agg((F.count(F.lit(1)) - 1).alias("extra"))
        return c.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("violations")).select(F.lit(name).alias("rule"), "violations")

    parts.append(dup("duplicate_id", F.col(id_col)))
    if text_col:
        parts.append(dup("duplicate_text", F.sha2(F.col(text_col), 256)))
    if level_col and per_level is not None:
        c = df.groupBy(level_col).agg(F.count(F.lit(1)).alias("n"))
        parts.append(c.agg(F.coalesce(F.sum((F.col("n") != per_level).cast("long")), F.lit(0)).alias("violations")).select(F.lit("level_count").alias("rule"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _labels_in_rows(node_type):
    """Arrow batches of (a, b), the ends of each instance's edges in both directions: the smallest node that each end in ``a`` reaches."""

    @F.pandas_udf(T.ArrayType(node_type))
    def labels(a: pd.Series, b: pd.Series) -> pd.Series:
        sizes = a.map(len).to_numpy()
        if not sizes.sum():
            return a
        nodes, code = np.unique(np.concatenate([*a, *b]), return_inverse=True)
        key = np.tile(np.repeat(np.arange(len(a)), sizes), 2) * len(nodes) + code  # nodes of different instances differ
        ids, at = np.unique(key, return_inverse=True)
        left, right = np.split(at, 2)
        label, before = np.arange(len(ids)), None
        while before is None or (label != before).any():
            before = label.copy()
            np.minimum.at(label, left, before[right])
            label = label[label]
        return pd.Series(np.split(nodes[ids[label[left]] % len(nodes)], np.cumsum(sizes)[:-1]))

    return labels


def components(edges: DataFrame, instance: str, max_rounds: int = 60, hops: int = 2, limit: int = 1024) -> DataFrame:
    """Smallest reachable node per (instance, node).

    An instance of up to ``limit`` distinct directed edges is labelled in its own row, without a shuffle per round; larger ones
    take part in the rounds of ``_propagate``, with the same result.
    """
    u, v = F.col("u"), F.col("v")
    ends = F.array(*[F.struct(x.alias("a"), y.alias("b")) for x, y in ((u, v), (v, u), (u, u), (v, v))])  # a node is its own neighbour
    both = cut_lineage(edges.select(instance, F.explode(ends).alias("_e")).select(instance, "_e.*").distinct())
    big = cut_lineage(both.groupBy(instance).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(instance))
    packed = both.join(big, instance, "left_anti").groupBy(instance).agg(F.collect_list(F.struct("a", "b")).alias("_p"))
    row = packed.select(instance, F.col("_p.a").alias("_a"), _labels_in_rows(both.schema["a"].dataType)("_p.a", "_p.b").alias("_l"))
    found = F.explode(F.array_distinct(F.arrays_zip(F.col("_a").alias("node"), F.col("_l").alias("label"))))
    labels = row.select(instance, found.alias("_f")).select(instance, "_f.node", "_f.label")
    if big.isEmpty():
        return labels
    return labels.unionByName(_propagate(both.join(big, instance, "left_semi"), instance, max_rounds, hops))


def _propagate(both: DataFrame, instance: str, max_rounds: int, hops: int) -> DataFrame:
    """Min-label propagation with pointer jumping over (instance, a, b), the edges in both directions.

    A round takes the smallest label of the neighbours ``hops`` times and then the label's own label, so
    the number of rounds grows with the logarithm of the diameter; each round's labels are written once.
    """
    both = cut_lineage(both)

    def spread(labels: DataFrame) -> DataFrame:
        return both.join(labels.select(instance, F.col("node").alias("b"), "label"), [instance, "b"]).groupBy(
            instance, F.col("a").alias("node")).agg(F.min("label").alias("label"))

    labels = cut_lineage(both.groupBy(instance, F.col("a").alias("node")).agg(F.min("b").alias("label")))
    for _ in range(max_rounds):
        moved = labels
        for _hop in range(hops):
            moved = spread(moved)
        old = labels.select(instance, "node", F.col("label").alias("old"))
        jump = labels.select(instance, F.col("node").alias("label"), F.col("label").alias("jump"))
        nxt = cut_lineage(moved.join(old, [instance, "node"]).join(jump, [instance, "label"]).select(
            instance, "node", "old", F.least("label", "jump").alias("label")))
        done = nxt.where("label <> old").isEmpty()
        labels = nxt.drop("old")
        if done:
            return labels
    raise RuntimeError("label propagation did not settle")


def graph_connected(edges: DataFrame, nodes: DataFrame, instance: str) -> DataFrame:
    """Is each instance one component?  nodes(instance, node) adds isolated nodes."""
    labels = components(edges, instance)
    full = nodes.select(instance, "node").distinct().join(labels, [instance, "node"], "left")
    comp = full.withColumn("label", F.coalesce("label", "node")).select(instance, "label").distinct()
    return comp.groupBy(instance).agg(F.count(F.lit(1)).alias("n_components")).withColumn("connected", F.col("n_components") == 1)


def verify_colouring(df: DataFrame, instance: str, text: str, edges: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Parse 'Node i: Colour' text, check the colours and the edges."""
    from levelscan.operators.joins import check_colouring

    node = F.regexp_extract_all(text, F.lit(r"Node (\d+): (\w+)"), F.lit(1))
    word = F.regexp_extract_all(text, F.lit(r"Node (\d+): (\w+)"), F.lit(2))
    col = df.select(instance, F.explode(F.arrays_zip(node.alias("n"), word.alias("c"))).alias("_p")).select(
        instance, F.col("_p.n").cast("int").alias("node"), F.lower("_p.c").alias("colour"))
    known = col.groupBy(instance).agg(F.bool_and(F.col("colour").isin(*allowed)).alias("colours_ok"))
    ok = check_colouring(edges, col, instance)
    return ok.join(known, instance, "left").select(
        instance, "n_violated", (F.col("valid") & F.coalesce("colours_ok", F.lit(False))).alias("verified"))


def response_sanity(rows: DataFrame, keys: Sequence[str], min_rate: float = 0.5, ends: int = 3) -> DataFrame:
    """Extraction rate, empty answers, easy (first levels) against hard (last levels) accuracy, per series."""
    per = rows.groupBy(*keys, "level").agg(
        F.count(F.lit(1)).alias("n"), F.count("answer").alias("ok"), F.avg(F.col("correct").cast("double")).alias("acc"))
    up = F.row_number().over(W.partitionBy(*keys).orderBy("level"))
    down = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("level").desc()))
    per = per.withColumns({"_up": up, "_down": down})
    out = per.groupBy(*keys).agg(
        (F.sum("ok") / F.sum("n")).alias("extraction_rate"),
        (F.sum("n") - F.sum("ok")).alias("n_empty"),
        F.avg(F.when(F.col("_up") <= ends, F.col("acc"))).alias("easy_accuracy"),
        F.avg(F.when(F.col("_down") <= ends, F.col("acc"))).alias("hard_accuracy"),
    )
    return out.withColumns({"rate_ok": F.col("extraction_rate") >= min_rate, "order_ok": F.col("easy_accuracy") >= F.col("hard_accuracy")})
