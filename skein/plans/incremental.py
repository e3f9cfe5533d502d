"""Pipeline status kept up to date by deltas: only the jobs that a delta touches are computed anew.

Activities are an append-only log, one folder for each delta and in it one for each bucket of jobs; of an activity the row of the
latest delta counts. A delta's jobs are known from its own rows, so the log is read in their buckets alone, and their status takes
the place of the old one in a new version of the stored table. The journal names the delta that a version includes; a delta whose
run failed left nothing that readers see, and its folder is written over by the next.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.views import AS_OF, SETTLE_DAYS, pipeline_status
from skein.sources.sinks import Layer, replace_by_key
from skein.sources.tables import kept

BUCKETS = 64
NAME = "pipeline_status"
COLUMNS = "activity_id long, job_id long, type_name string, activity_date date, deleted boolean"


class StatusStore:
    """The stored status of all jobs in a layer, and the log it was made from."""

    def __init__(self, layer: Layer, as_of: dt.date = AS_OF, settle_days: int = SETTLE_DAYS, buckets: int = BUCKETS) -> None:
        self.layer, self.spark, self.buckets = layer, layer.spark, buckets
        self.as_of, self.settle_days = as_of, settle_days

    @property
    def log_path(self) -> str:
        return f"{self.layer.root}/activity_log"

    def deltas(self) -> int:
        """How many deltas the current version includes."""
        runs = self.layer.journal().where((F.col("source") == NAME) & (F.col("status") == "ok"))
        return int(runs.agg(F.max(F.regexp_extract("note", r"delta=(\d+)", 1).cast("int"))).first()[0] or 0)

    def _bucket(self):
        return F.pmod(F.xxhash64("job_id"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _activities(self, upto: int, touched: DataFrame) -> DataFrame:
        """The activities of the touched jobs after the first deltas: the latest row of each, without those deleted."""
        log = self.spark.read.schema(f"{COLUMNS}, delta int, bucket int").parquet(self.log_path).where(F.col("delta") <= upto)
        rows = log
        if upto > 1:  # the first delta's jobs are all touched
            own = [r.bucket for r in touched.select(self._bucket()).distinct().collect()]  # at most ``buckets`` numbers
            rows = log.where(F.col("bucket").isin(own)).join(touched, "job_id", "left_semi")
        last = rows.groupBy("job_id", "activity_id").agg(F.max_by(F.struct("type_name", "activity_date", "deleted"), "delta").alias("row"))
        return last.where("not row.deleted").select("job_id", "activity_id", "row.type_name", "row.activity_date")

    def status(self) -> DataFrame:
        return self.layer.read(NAME)

    def apply(self, jobs: DataFrame, activities: DataFrame) -> DataFrame:
        """Takes in a delta: jobs (new or changed; key job_id) and activities (new, changed or, where ``deleted``, gone; key activity_id).

        An activity stays with its job: to move it, delete it under the old one. Rows of a job that is not known yet wait for it. The
        first delta is the full build; an empty one makes a version that equals the last.
        """
        number = self.deltas() + 1
        acts = activities.withColumn("deleted", F.coalesce("deleted", F.lit(False)) if "deleted" in activities.columns else F.lit(False))
        typed = acts.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in COLUMNS.split(", ")], self._bucket())
        typed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.log_path}/delta={number}")
        given = kept(jobs.select("job_id", "job_name"), "jobs")
        known = self.layer.read("status_jobs", given.schema)
        if number == 1 or not given.isEmpty():  # without jobs the table of them stays
            known = self.layer.upsert("status_jobs", given, ["job_id"])
        log = self.spark.read.schema(f"{COLUMNS}, delta int, bucket int").parquet(self.log_path).where(F.col("delta") == number)
        touched = kept(given.select("job_id").union(log.select("job_id")).distinct(), "touched")
        fresh = pipeline_status(known.join(touched, "job_id", "left_semi"), self._activities(number, touched), self.as_of, self.settle_days)
        try:
            old = self.status()
        except LookupError:
            old = fresh.limit(0)
        return self.layer.rebuild(NAME, replace_by_key(old, fresh, touched, ["job_id"]), f"delta={number}")

    def compact(self) -> None:
        """Writes the log as a single delta of the rows that count; the status stays as it is."""
        number = self.deltas()
        try:
            log = self.spark.read.schema(f"{COLUMNS}, delta int, bucket int").parquet(self.log_path).where(F.col("delta") <= number)
        except AnalysisException:
            return
        last = log.groupBy("bucket", "job_id", "activity_id").agg(F.max_by(F.struct("type_name", "activity_date", "deleted"), "delta").alias("row"))
        rows = kept(last.where("not row.deleted").select("activity_id", "job_id", "row.type_name", "row.activity_date", F.lit(False).alias("deleted"), "bucket"), "log")
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.log_path}/delta={number}")
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.log_path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for n in range(1, number):
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(root, f"delta={n}"), True)
