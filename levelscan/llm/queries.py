"""The registered queries of this folder, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from levelscan.llm import ann_tree, bpe, exact_dedup, html_extract, language_id, lexical_search, license_scan, line_dedup, minhash, mixing, periodic_runs, sharding, suffix_dedup


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_documents(_documents(spark, folder))


def op2_ann_tree(spark: SparkSession, folder: str) -> DataFrame:
    return ann_tree.nearest_neighbours(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.language_of_documents(_documents(spark, folder))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_digests(_documents(spark, folder), bpe.vocabulary_path())


def op5_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{folder}/pages.parquet"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, folder))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.deduplicate(_documents(spark, folder))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(_documents(spark, folder), shrink=True)


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, folder), k=2)


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.op10_interleaved_sharding(_documents(spark, folder))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.ranked_search(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.run_digests(_documents(spark, folder))


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_digests(_documents(spark, folder))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_ann_tree, op3_language_id, op4_bpe, op5_html_extract, op6_suffix_dedup, op7_exact_dedup, op8_mixing, op9_minhash, op10_sharding, op11_lexical_search, op12_periodic_runs, op13_line_dedup)}
ORACLES = {"op1_license_scan": license_scan.SQL, "op7_exact_dedup": exact_dedup.SQL, "op8_mixing": mixing.SQL, "op9_minhash": minhash.SQL, "op10_sharding": sharding.SQL, "op11_lexical_search": lexical_search.SQL, "op13_line_dedup": line_dedup.SQL}
