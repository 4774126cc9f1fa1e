"""Enough tasks for costly per-row work on inputs with few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread a scan that has fewer splits than the cluster has cores; anything larger is left alone.

    For tables as read (no shuffle in the plan): a table of many files already has its splits.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *keys)
