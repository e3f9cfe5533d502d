"""Pages as a stream: each new file of a folder is split into tables and upserted into the layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.sources.ingest import PAGE_SCHEMA, split_pages
from skein.sources.sinks import Layer, replace_by_key

KEYS = {"jobs": ["job_id"], "activities": ["activity_id"], "job_forms": ["form_id"], "job_summary": ["job_id"]}


def load(layer: Layer, pages: DataFrame) -> None:
    """Pages into the layer: keyed tables are upserted, contacts and fields of the jobs seen are replaced. A rerun changes nothing.

    A job that comes twice in a batch counts once, with the greater of its two records.
    """
    once = pages.groupBy(F.col("job.jobId").alias("id")).agg(F.max("job").alias("job")).select("job")
    tables = split_pages(once)
    for name, df in tables.items():
        if name in KEYS:
            layer.upsert(name, df.dropDuplicates(KEYS[name]), KEYS[name])
        else:
            layer.rebuild(name, replace_by_key(layer.read(name, df.schema), df, tables["jobs"], ["job_id"]))


def stream_pages(spark: SparkSession, path: str, layer: Layer, checkpoint: str) -> StreamingQuery:
    """Loads the files there are now and ends; started again with the same checkpoint it takes only new ones."""
    pages = spark.readStream.schema(PAGE_SCHEMA).option("multiLine", True).json(path).select(F.explode("jobs").alias("job"))
    return pages.writeStream.foreachBatch(lambda batch, _: load(layer, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
