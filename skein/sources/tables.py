"""Parquet tables by name, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``; Spark's reader opens any file system."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only in local mode, where they are one process."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='skein-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Whether a query's shuffle files go when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def put(df: DataFrame, name: str, by: str | None = None) -> str:
    """Writes ``df`` to a new path in the shared folder (in folders ``by`` a column).

    Its shuffle files go when it is written; else they stay until the driver happens to collect its garbage, beside those of all
    tables that are written before that.
    """
    path, conf = f"{shared_dir(df.sparkSession)}/skein-{name}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(RELEASE, None)
    conf.set(RELEASE, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        if before is None:
            conf.unset(RELEASE)
        else:
            conf.set(RELEASE, before)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, for plans that read it in several places; whoever owns the folder clears it."""
    return df.sparkSession.read.schema(df.schema).parquet(put(df, name))
