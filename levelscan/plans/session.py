"""Session settings, the shared scratch folder, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def session(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("levelscan")
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where none is configured and Spark runs on one machine (tests, laptops) a scratch folder is used.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[sc.applicationId]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table once to the shared folder and read it back.

    Used where several branches or rounds read the same intermediate table: the rows behind it are
    scanned once, a lost executor reads files again, columns are pruned, and Spark knows the size, so
    it can choose broadcast joins.
    """
    path = f"{shared_folder(df.sparkSession)}/levelscan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
