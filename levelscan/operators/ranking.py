"""Top-k, best-per-group and set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def top_k(df: DataFrame, metric: str, k: int, tie: str, ascending: bool = False) -> DataFrame:
    m = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return df.orderBy(m, F.col(tie)).limit(k)


def best_per_group(df: DataFrame, group: Sequence[str], metric: str, name: str) -> DataFrame:
    """Best row per group by an aggregate, no window: the smallest name wins a tie."""
    best = F.min_by(F.struct(F.col(name), F.col(metric)), F.struct(-F.col(metric), F.col(name)))
    return df.where(F.col(metric).isNotNull()).groupBy(*group).agg(best.alias("_b")).select(*group, "_b.*")


def rank_methods(methods: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """Composite score and rank of a short method table."""
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    scored = methods.withColumn("composite", total)
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("composite").desc(), name)))


def peak_levels(series: DataFrame, keys: Sequence[str] = ("task", "model")) -> DataFrame:
    """Level of the highest variance and of the accuracy nearest one half, and how well they agree."""
    gap = F.abs(F.col("accuracy") - 0.5)
    out = series.groupBy(*keys).agg(
        F.min_by("level", F.struct(-F.col("variance"), F.col("level"))).alias("peak_level"),
        F.min_by("level", F.struct(gap, F.col("level"))).alias("half_level"),
    )
    d = F.abs(F.col("peak_level") - F.col("half_level"))
    return out.withColumns({"match_within_1": d <= 1, "match_within_2": d <= 2})


def first_per_key(df: DataFrame, key: Sequence[Column], row_id: str) -> DataFrame:
    """First row per key by an explicit row id; an aggregate, so a hot key combines on the map side."""
    names = [f"_k{i}" for i in range(len(key))]
    rest = [c for c in df.columns if c != row_id]
    return (
        df.groupBy(*[k.alias(n) for k, n in zip(key, names)])
        .agg(F.min(row_id).alias(row_id), F.min_by(F.struct(*rest), row_id).alias("_row"))
        .select(row_id, "_row.*")
    )


def dedup_normalized(df: DataFrame, text: str, row_id: str) -> DataFrame:
    """Row ids of the first row per lower/trim text; the key travels as a hash, not as the text."""
    key = F.sha2(F.lower(F.trim(F.col(text))), 256)
    return df.groupBy(key.alias("_k")).agg(F.min(row_id).alias(row_id), F.count(F.lit(1)).alias("copies")).drop("_k")


def edge_set_key(edges: str | Column) -> Column:
    """Canonical text of an undirected edge set."""
    e = F.col(edges) if isinstance(edges, str) else edges
    return F.to_json(F.array_sort(F.array_distinct(F.transform(e, lambda p: F.array_sort(p)))))


def dedup_edge_set(graphs: DataFrame, edges: str, row_id: str) -> DataFrame:
    return graphs.groupBy(edge_set_key(edges).alias("_k")).agg(
        F.min(row_id).alias(row_id), F.count(F.lit(1)).alias("copies")
    ).drop("_k")


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every key with its membership: 'both', 'left' or 'right' (union, intersection and difference in one pass)."""
    both = a.select(key).withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(
        b.select(key).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))
    )
    m = both.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    side = F.when((F.col("_a") == 1) & (F.col("_b") == 1), "both").when(F.col("_a") == 1, "left").otherwise("right")
    return m.select(key, side.alias("side"))


def unique_sets(df: DataFrame, array_col: str | Column) -> DataFrame:
    c = F.col(array_col) if isinstance(array_col, str) else array_col
    per = df.groupBy(F.sha2(F.to_json(F.array_sort(c)), 256).alias("_k")).agg(F.count(F.lit(1)).alias("c"))
    return per.agg(
        F.count(F.lit(1)).alias("n_unique"), F.sum("c").alias("n_rows"), F.sum((F.col("c") > 1).cast("long")).alias("n_repeated")
    )


def union_examples(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)
