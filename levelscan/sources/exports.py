"""Level and response exports with per-export column names, brought to one level table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Canonical level-table columns and their names in the exports read here.
CANONICAL = (
    "accuracy", "variance", "dip_statistic", "dip_pvalue", "silhouette_k2",
    "bimodality_coefficient", "disagreement_rate", "ashman_d",
)
LEVEL_EXPORT = {
    "metadata_difficulty_level": "level", "metadata_model": "model", "metadata_d_star": "d_star",
    "predict_accuracy": "accuracy", "predict_csd_variance": "variance",
    "predict_dip_statistic": "dip_statistic", "predict_dip_pvalue": "dip_pvalue",
    "predict_silhouette_k2": "silhouette_k2", "predict_bimodality_coefficient": "bimodality_coefficient",
    "predict_disagreement_rate": "disagreement_rate",
}
RESPONSE_EXPORT = {
    "metadata_difficulty_level": "level", "metadata_difficulty": "level", "metadata_model": "model",
    "metadata_csd_accuracy": "accuracy", "metadata_csd_embedding_variance": "variance",
    "metadata_csd_dip_statistic": "dip_statistic", "metadata_csd_dip_pvalue": "dip_pvalue",
    "metadata_csd_silhouette_score": "silhouette_k2", "metadata_csd_silhouette_k2": "silhouette_k2",
    "metadata_csd_bimodality_coefficient": "bimodality_coefficient",
    "metadata_csd_disagreement_rate": "disagreement_rate", "metadata_csd_ashman_d": "ashman_d",
}
MAP_EXPORT = {
    "accuracy": "accuracy", "embedding_variance_trace": "variance", "hartigan_dip_stat": "dip_statistic",
    "hartigan_dip_pval": "dip_pvalue", "silhouette_score_k2": "silhouette_k2",
    "bimodality_coefficient": "bimodality_coefficient", "self_consistency_disagreement": "disagreement_rate",
    "ashman_d": "ashman_d",
}


def number(c: Column | str) -> Column:
    """Double from text or number; NaN and anything unparsable become NULL."""
    v = (F.col(c) if isinstance(c, str) else c).cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


def _renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def levels_from_level_export(df: DataFrame, names: Mapping[str, str] = LEVEL_EXPORT) -> DataFrame:
    """One example is one level; numbers arrive as text."""
    df = _renamed(df, names)
    nums = {c: number(c) for c in CANONICAL if c in df.columns}
    return df.withColumns(nums | {"level": F.col("level").cast("int")})


def levels_from_response_export(
    df: DataFrame, keys: Sequence[str] = ("model", "level"), row_id: str = "row_id", names: Mapping[str, str] = RESPONSE_EXPORT
) -> DataFrame:
    """Level indicators repeated on every response row: the first row per key, by an explicit row id."""
    df = _renamed(df, names)
    cols = [c for c in CANONICAL if c in df.columns]
    first = F.min_by(F.struct(*[number(c).alias(c) for c in cols]), row_id)
    return df.groupBy(*keys).agg(first.alias("_f")).select(*keys, "_f.*")


def levels_from_map_metadata(df: DataFrame, column: str = "per_level_indicators", names: Mapping[str, str] = MAP_EXPORT) -> DataFrame:
    """Map level -> struct (or map) of indicators, one row per level; absent fields are NULL."""
    keys = [c for c in df.columns if c != column]
    rows = df.select(*keys, F.explode(column).alias("level", "_v"))
    kind = rows.schema["_v"].dataType
    have = set(kind.fieldNames()) if hasattr(kind, "fieldNames") else None
    cols = []
    for src, dst in names.items():
        if have is None:
            cols.append(number(F.try_element_at(F.col("_v"), F.lit(src))).alias(dst))
        elif src in have:
            cols.append(number(F.col("_v")[src]).alias(dst))
        else:
            cols.append(F.lit(None).cast("double").alias(dst))
    return rows.select(*keys, F.col("level").cast("int").alias("level"), *cols)


def temperature_of(dataset: Column | str) -> Column:
    c = F.col(dataset) if isinstance(dataset, str) else dataset
    return F.nullif(F.regexp_extract(c, r"_T([0-9.]+)__", 1), F.lit("")).try_cast("double")


def levels_from_temperature_export(df: DataFrame, names: Mapping[str, str] = LEVEL_EXPORT) -> DataFrame:
    """As the level export, with the temperature as part of the series key (a column, or in the dataset name)."""
    t = temperature_of("dataset")
    if "metadata_temperature" in df.columns:
        t = F.coalesce(number("metadata_temperature"), t)
    return levels_from_level_export(df.withColumn("temperature", t), names)


def unify_levels(parts: Sequence[DataFrame]) -> DataFrame:
    """Union into one schema; an indicator a part does not have is NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumns({c: F.lit(None).cast("double") for c in CANONICAL if c not in out.columns})


def parse_prefixed(df: DataFrame, prefix: str = "predict_") -> DataFrame:
    return df.select(
        *[number(c).alias(c.removeprefix(prefix)) if c.startswith(prefix) else F.col(c) for c in df.columns]
    )


def select_dataset(df: DataFrame, name: str) -> DataFrame:
    """Rows of one named dataset; evaluating an absent name fails instead of giving an empty result."""
    guard = df.groupBy().agg(F.max((F.col("dataset") == name).cast("int")).alias("_m")).select(
        F.when(F.coalesce(F.col("_m"), F.lit(0)) == 1, F.lit(name)).otherwise(F.raise_error(F.lit(f"no dataset {name}"))).alias("dataset")
    )
    return df.where(F.col("dataset") == name).join(guard, "dataset", "left").select(df.columns)


def level_series_of(df: DataFrame, name: str, level_key: str, value_key: str) -> DataFrame:
    """(level, value) pairs of one dataset; rows that do not parse are skipped."""
    lv, v = number(level_key).cast("int"), number(value_key)
    return df.where(F.col("dataset") == name).select(lv.alias("level"), v.alias("value")).where(
        F.col("level").isNotNull() & F.col("value").isNotNull()
    )


def text_lines(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Numbered lines (from 1) of each document."""
    return df.select(doc, F.posexplode(F.split(F.col(text), "\n")).alias("_p", "line")).select(
        doc, (F.col("_p") + 1).alias("line_no"), "line"
    )
