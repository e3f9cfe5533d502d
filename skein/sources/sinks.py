"""Sinks without MERGE: upserts as plans, versioned Parquet layers and an append-only run journal that names the current version."""

from __future__ import annotations

import traceback
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

JOURNAL_SCHEMA = "run_id string, source string, status string, at timestamp, rows_out bigint, version string, error string, note string"


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys; null keys are equal. Keys of new are unique."""
    o, n = old.alias("o"), new.select(*keys).distinct().alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return o.join(n, on, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_by_key(old: DataFrame, new: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without all rows of the touched keys, and all of ``new``; keys that new no longer has lose their rows."""
    return old.join(touched.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


class Layer:
    """Tables as Parquet folders, one for each version. A version counts once the journal says that its run ended well."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def journal_path(self) -> str:
        return f"{self.root}/pipeline_runs"

    def journal(self) -> DataFrame:
        try:
            return self.spark.read.schema(JOURNAL_SCHEMA).parquet(self.journal_path)
        except AnalysisException:
            return self.spark.createDataFrame([], JOURNAL_SCHEMA)

    def note(self, run_id: str, source: str, status: str, rows_out: int | None = None, version: str | None = None, error: str | None = None, note: str | None = None) -> None:
        row = self.spark.createDataFrame([(run_id, source, status, None, rows_out, version, error, note)], JOURNAL_SCHEMA)
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.journal_path)

    def read(self, name: str, schema: StructType | None = None) -> DataFrame:
        """The current version; an empty table of ``schema`` if there is none."""
        last = self.journal().where((F.col("source") == name) & (F.col("status") == "ok")).agg(F.max_by("version", "at")).first()[0]
        if last is None:
            if schema is None:
                raise LookupError(f"no version of {name}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{name}/{last}")

    def rebuild(self, name: str, df: DataFrame, note: str | None = None) -> DataFrame:
        """Writes ``df`` as the new version; readers of the old one are not disturbed."""
        with self.run(name) as result:
            version = uuid.uuid4().hex
            path = f"{self.root}/{name}/{version}"
            df.write.parquet(path)
            out = self.spark.read.schema(df.schema).parquet(path)
            result |= {"version": version, "rows_out": out.count(), "note": note}
        return out

    def upsert(self, name: str, new: DataFrame, keys: list[str]) -> DataFrame:
        return self.rebuild(name, upsert(self.read(name, new.schema), new, keys))

    @contextmanager
    def run(self, source: str) -> Iterator[dict]:
        """A journalled run: running, then ok with what the block put into the dict, or failed with the error."""
        run_id, result = uuid.uuid4().hex, {}
        self.note(run_id, source, "running")
        try:
            yield result
        except Exception:
            self.note(run_id, source, "failed", error=traceback.format_exc()[-2000:])
            raise
        self.note(run_id, source, **({"status": "ok"} | result))
