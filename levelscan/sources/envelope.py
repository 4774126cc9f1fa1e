"""JSON envelope files ({metadata, datasets: [{dataset, examples: [...]}]}) and flat example files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def _json(spark: SparkSession, path, schema: T.StructType | str | None):
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_envelope(spark: SparkSession, path, example_schema: str | None = None) -> DataFrame:
    """One row per example with its dataset name.

    With ``example_schema`` (DDL of the example fields) no inference pass runs.  One envelope file is
    one task; large exports belong in parquet, many envelope files are read in parallel.
    """
    schema = None
    if example_schema:
        schema = f"datasets array<struct<dataset: string, examples: array<struct<{example_schema}>>>>"
    return _json(spark, path, schema).selectExpr("inline(datasets)").selectExpr("dataset", "inline(examples)")


def read_flat_or_envelope(spark: SparkSession, path) -> DataFrame:
    raw = _json(spark, path, None)
    if "datasets" in raw.columns:
        return raw.selectExpr("inline(datasets)").selectExpr("dataset", "inline(examples)")
    if "examples" in raw.columns:
        return raw.selectExpr("inline(examples)")
    return raw


def tier_path(spark: SparkSession, folder: str, name: str, tier: str = "full") -> str:
    """Path of the wanted tier, falling back to the file without a prefix; works on any Hadoop file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for candidate in (f"{folder}/{tier}_{name}", f"{folder}/{name}"):
        p = jvm.org.apache.hadoop.fs.Path(candidate)
        if p.getFileSystem(conf).exists(p):
            return candidate
    raise FileNotFoundError(f"{folder}/{name}")


def load_tier(spark: SparkSession, folder: str, name: str, tier: str = "full") -> DataFrame:
    return read_envelope(spark, tier_path(spark, folder, name, tier))


def envelope_rows(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Nested JSON rows (dataset, piece, examples); a dataset is written in pieces of about ``max_rows`` examples.

    A piece is a hash bucket, so one huge dataset never meets in one task; pieces are numbered from 0, a single one too.
    """
    body = [c for c in df.columns if c != "dataset"]
    sizes = df.groupBy("dataset").agg(F.ceil(F.count(F.lit(1)) / max_rows).alias("_pieces"))
    piece = F.pmod(F.xxhash64(*body), F.col("_pieces"))
    return (
        df.join(sizes, "dataset").groupBy("dataset", piece.alias("piece"))
        .agg(F.collect_list(F.struct(*body)).alias("examples"))
    )


def write_envelope(df: DataFrame, path: str, max_rows: int = 100_000) -> None:
    """Every file is one envelope document with one piece of one dataset."""
    rows = envelope_rows(df, max_rows)
    doc = rows.select(F.array(F.struct("dataset", "piece", "examples")).alias("datasets"))
    doc.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)
