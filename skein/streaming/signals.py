"""The signals of each job as streaming state: activities arrive in any order, late and repeated, and the facts stay those of a batch.

State keeps for each activity of a job the version it was last seen in, so a row of an older version, or the same again, changes
nothing; state lives in the state store and its checkpoint, not in memory, so a restart goes on where it was.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skein.plans.views import AS_OF, MOVES, SIGNALS
from skein.sources.sinks import Layer

EVENTS = "job_id long, activity_id long, version long, type_name string, activity_date date"
#: What an activity counts as: a quote, measure or template by its strength, a move, or nothing.
MOVE, NOTHING = -1, 0
STRENGTH = {t: len(SIGNALS) - i for i, t in enumerate(SIGNALS)}
#: A row of the state; what a job's activities say, with days as numbers and NONE for no day.
ROW = np.dtype([("job_id", "<i8"), ("activity_id", "<i8"), ("version", "<i8"), ("day", "<i4"), ("kind", "i1")])
NONE = -(1 << 31)
FOUND = "job_id long, first int, last int, move int, source int, " + ", ".join(f"had_{n} boolean" for n in STRENGTH.values()) + ", shard int"
#: State is kept for so many buckets of jobs: a call to the store for each job is what a large batch would wait for.
BUCKETS = 1024
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobSignals(StatefulProcessor):
    """Keeps the latest version of each activity of a bucket of jobs, read and written once a batch as one array, and gives the facts of each job of which one has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("activities", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.seen.get()
        old = np.frombuffer(bytes(held[0]), ROW) if held else np.empty(0, ROW)
        frames = [self.packed(f) for f in rows]
        both, fresh = np.concatenate([*frames, old]), sum(len(f) for f in frames)
        order = np.lexsort([both[c] for c in ("day", "kind", "version", "activity_id", "job_id")])  # of rows that are equal the old one is last
        job, activity = both["job_id"][order], both["activity_id"][order]
        order = order[np.append((job[1:] != job[:-1]) | (activity[1:] != activity[:-1]), True)]
        now = both[order]
        changed = now["job_id"][order < fresh]
        if len(changed):
            self.seen.update((now.tobytes(),))
            yield self.facts(now[np.isin(now["job_id"], changed)]).assign(shard=np.int32(key[1]))

    @staticmethod
    def packed(frame: pd.DataFrame) -> np.ndarray:
        out = np.empty(len(frame), ROW)
        for c in ROW.names:
            out[c] = frame[c].to_numpy()
        return out

    @staticmethod
    def facts(rows: np.ndarray) -> pd.DataFrame:
        """FOUND of rows that are sorted by job."""
        job, first = np.unique(rows["job_id"], return_index=True)
        kind, day = rows["kind"], rows["day"].astype(np.int64)
        signal, move = kind > NOTHING, kind == MOVE
        least = lambda which: np.minimum.reduceat(np.where(which, day, -NONE), first)
        # the strongest signal of the last day with one
        last = np.maximum.reduceat(np.where(signal, day * 4 + kind, NONE * 4), first)
        found = {"first": least(signal), "last": last // 4, "move": least(move)}
        days = {n: np.where(abs(v) == -NONE, NONE, v).astype(np.int32) for n, v in found.items()}
        had = {f"had_{n}": np.logical_or.reduceat(kind == n, first) for n in STRENGTH.values()}
        return pd.DataFrame({"job_id": job, **days, "source": (last % 4).astype(np.int32), **had})


def merged(facts: DataFrame) -> DataFrame:
    """The facts of each job (views.signal_facts) from those of its shards."""
    strength = F.lit(NOTHING)
    for t, n in STRENGTH.items():
        strength = F.when(F.col("signal_source") == t.lower(), n).otherwise(strength)
    last = F.when(F.col("signal_source").isNotNull(), F.struct("last_signal_date", strength))
    return facts.groupBy("job_id").agg(
        F.min("first_signal_date").alias("first_signal_date"), F.max("last_signal_date").alias("last_signal_date"), F.max_by("signal_source", last).alias("signal_source"),
        *[F.bool_or(f"had_dated_{t.lower()}").alias(f"had_dated_{t.lower()}") for t in SIGNALS], F.min("first_move_date").alias("first_move_date"),
    )


@contextmanager
def _rocks(spark: SparkSession):
    """The state store that keeps maps, for queries that start here."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def job_signals(events: DataFrame, as_of: dt.date = AS_OF, shards: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """The facts of a shard of a job whenever they may have changed, from a stream of its activities (EVENTS); see merged.

    Of an activity the greatest version counts; of rows of one version the greatest, so that any order gives the same. Jobs and
    activities without an id are left out. A shard's activities are held together, so ``shards`` is raised where a job may have
    very many. A bucket's state is written whole if a row of it changes. Both numbers stay the same for a checkpoint.
    """
    kind, day = F.col("type_name"), F.col("activity_date")
    strength = F.lit(NOTHING)
    for t, n in STRENGTH.items():
        strength = F.when((kind == t) & (day <= F.lit(as_of)), n).otherwise(strength)
    strength = F.when(kind.isin(*MOVES) & day.isNotNull(), MOVE).otherwise(strength)
    rows = events.where("job_id is not null and activity_id is not null").select(
        "job_id", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int").alias("bucket"), F.pmod(F.xxhash64("activity_id"), F.lit(shards)).cast("int").alias("shard"), "activity_id", F.coalesce("version", F.lit(0).cast("long")).alias("version"),
        strength.cast("int").alias("kind"), F.coalesce(F.unix_date(day), F.lit(0)).alias("day"),
    )
    found = rows.groupBy("bucket", "shard").transformWithStateInPandas(JobSignals(), FOUND, "Update", "None")
    day = lambda c: F.when(F.col(c) != NONE, F.date_from_unix_date(c))
    source = F.lit(None).cast("string")
    for t, n in STRENGTH.items():
        source = F.when(F.col("source") == n, t.lower()).otherwise(source)
    return found.select(
        "job_id", "shard", day("first").alias("first_signal_date"), day("last").alias("last_signal_date"), source.alias("signal_source"),
        *[F.col(f"had_{n}").alias(f"had_dated_{t.lower()}") for t, n in STRENGTH.items()], day("move").alias("first_move_date"),
    )


def stream_signals(spark: SparkSession, path: str, layer: Layer, checkpoint: str, name: str = "job_signals", per_trigger: int | None = None, shards: int = 1) -> StreamingQuery:
    """Takes in the Parquet files there are now and ends; started again with the same checkpoint it takes only new ones.

    The layer's table ``name`` has the last facts of each shard; a batch that is run again upserts the same rows.
    """
    reader = spark.readStream.schema(EVENTS)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    with _rocks(spark):
        facts = job_signals(reader.parquet(path), shards=shards)
        return facts.writeStream.outputMode("update").foreachBatch(lambda batch, _: layer.upsert(name, batch, ["job_id", "shard"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
