"""Exact deduplication: a tree-merge of sorted digest runs.

Every document becomes one row: digest, check, and what decides who stays. The rows of a partition, sorted by digest, are a run,
so there are as many runs as the input has partitions. Runs are merged in binomial rounds: in round k, FAN_IN neighbouring runs
(each already of FAN_IN^(k-1) partitions) exchange the rows of each of FAN_IN^k digest ranges, so that a task always merges about
as many rows as one partition has. Runs travel as sorted chunks, and chunks arrive in the order of their first digests: what is
below the first digest of the next chunk is final, and a task holds no more than a few chunks of each run that it merges. Equal
rows become one at every level, with the one that stays and the count, so a group of copies shrinks before each exchange. A row
is equal to another if SHA-256 of the normalised text, its length and a second hash all agree, at every level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.llm.common import BLANKS, discard, packed, stash, written
from skein.sources.tables import table

#: Runs that are merged at once (a power of two); rows of a chunk; rows that are merged together.
FAN_IN, CHUNK, TOGETHER = 8, 4096, 1 << 16
#: Rows of a run, in the order in which they are sorted; of equal digests and checks, the first stays.
KEYS = ("digest", "length", "hash", "less", "none", "doc_id")
CHUNKS = "run long, range long, first binary, rows binary"


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text and others) with digest, check and size (code points of the text)."""
    norm = normalised(F.col("text"))
    return rows.withColumns(
        {
            "digest": F.unhex(F.sha2(norm.cast("binary"), 256)),
            "check": F.struct(F.octet_length(norm).alias("n"), F.xxhash64(norm).alias("x")),
            "size": F.coalesce(F.length("text"), F.lit(0)),
        }
    )


def reduced(rows: pa.Table) -> pa.Table:
    """One row of each distinct text of sorted rows: the first, with the sum of their counts."""
    if not rows.num_rows:
        return rows
    new = np.ones(rows.num_rows, bool)
    new[1:] = np.any([pc.not_equal(rows[c].combine_chunks()[1:], rows[c].combine_chunks()[:-1]).to_numpy(zero_copy_only=False) for c in KEYS[:3]], axis=0)
    first = np.flatnonzero(new)
    count = np.add.reduceat(rows["count"].to_numpy(), first)
    out = rows.take(pa.array(first))
    return out.set_column(out.schema.get_field_index("count"), "count", pa.array(count, pa.int64()))


def merged(runs: list[pa.Table], below: bytes | None = None) -> tuple[pa.Table, pa.Table]:
    """The rows of sorted runs as one: the distinct texts whose digest is below this one, and the rows that are not settled yet."""
    rows = pa.concat_tables(runs).combine_chunks()
    if len(runs) > 1:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in KEYS]))
    cut = rows.num_rows if below is None else pc.sum(pc.less(rows["digest"], pa.scalar(below, pa.binary()))).as_py() or 0
    return reduced(rows.slice(0, cut)), rows.slice(cut)


def chunks(rows: pa.Table, run: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows cut at the borders of 2^bits digest ranges and after CHUNK rows."""
    if not rows.num_rows:
        return
    digests = b"".join(rows["digest"].to_pylist())
    ranges = (np.frombuffer(digests, ">u8")[::4].astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    borders = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), rows.num_rows]
    cuts = [(i, min(i + CHUNK, hi)) for lo, hi in zip(borders[:-1], borders[1:], strict=True) for i in range(lo, hi, CHUNK)]
    for some in (cuts[i : i + 64] for i in range(0, len(cuts), 64)):
        values = []
        for lo, hi in some:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows.slice(lo, hi - lo))
            values.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([run] * len(some), pa.int64()), pa.array([int(ranges[lo]) for lo, _ in some], pa.int64()), pa.array([digests[32 * lo : 32 * lo + 32] for lo, _ in some], pa.binary()), pa.array(values, pa.binary())],
            names=["run", "range", "first", "rows"],
        )


def _runs(bits: int):
    """The sorted rows of a partition (and its number) as chunks of a run."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, number = None, 0
        for batch in parts:
            if not len(batch):
                continue
            number = batch.column(0)[0].as_py()
            # tables of one schema, whatever Spark knows of nulls
            rows = pa.Table.from_arrays(batch.columns[1:], schema=pa.schema([f.with_nullable(True) for f in list(batch.schema)[1:]]))
            # batches follow one another in order
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            done, rest = merged([rows], rows["digest"][-1].as_py())
            yield from chunks(done, number, bits)
            rest = reduced(rest)
        if rest is not None:
            yield from chunks(rest, number, bits)

    return run


def _merge(bits: int | None):
    """Chunks of the runs that meet in a task, in order of their first digests, as chunks of the merged run, or as rows where bits is None."""

    def out(rows: pa.Table, run: int) -> Iterator[pa.RecordBatch]:
        yield from chunks(rows, run, bits) if bits is not None else rows.to_batches()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, size = None, [], 0
        for batch in parts:
            for number, range_, first, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (number, range_) != key or size >= TOGETHER:
                    if waiting:
                        done, rest = merged(waiting, first if (number, range_) == key else None)
                        yield from out(done, key[0])
                        # copies of the digest at the border are one row already
                        waiting, size = [reduced(rest)], 0
                    key = (number, range_)
                rows = pa.ipc.open_stream(data).read_all()
                waiting.append(rows)
                size += rows.num_rows
        if waiting:
            yield from out(merged(waiting)[0], key[0])

    return run


def merge_runs(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """digest, check, best (doc_id of the row that stays) and group_size of each distinct text; a written table."""
    width = fan_in.bit_length() - 1
    doc_id = F.col("doc_id").cast("long") if isinstance(rows.schema["doc_id"].dataType, T.NullType) else F.col("doc_id")
    slim = rows.select(
        F.spark_partition_id().cast("long").alias("run"), "digest", F.col("check.n").cast("long").alias("length"), F.col("check.x").alias("hash"),
        (-F.col("size")).cast("long").alias("less"), F.col("doc_id").isNull().alias("none"), doc_id.alias("doc_id"), F.lit(1).cast("long").alias("count"),
    )
    kind = slim.schema["doc_id"].dataType.simpleString()
    level, path = written(slim.sortWithinPartitions(*KEYS).mapInArrow(_runs(width), CHUNKS), "runs")
    runs, rounds = (level.agg(F.max("run")).first()[0] or 0) + 1, 1
    while fan_in**rounds < runs:
        rounds += 1
    for k in range(1, rounds + 1):
        group = F.expr(f"run div {fan_in}").alias("run")
        met = level.select(group, "range", "first", "rows").repartition("run", "range").sortWithinPartitions("run", "range", "first")
        last = f"digest binary, length long, hash long, less long, none boolean, doc_id {kind}, count long"
        level = met.mapInArrow(_merge(width * (k + 1) if k < rounds else None), CHUNKS if k < rounds else last)
    check = F.struct(F.col("length").cast(rows.schema["check"].dataType["n"].dataType).alias("n"), F.col("hash").alias("x"))
    found = stash(level.select("digest", check.alias("check"), F.struct("doc_id").alias("best"), F.col("count").alias("group_size")), "winners")
    discard(rows.sparkSession, path)
    return found


def decide(rows: DataFrame) -> DataFrame:
    """keep_id, group_size, kept and text_sha256 beside the columns of ``rows`` (those of digests())."""
    winners = merge_runs(rows).select(F.col("digest").alias("d"), F.col("check").alias("c"), F.col("best.doc_id").alias("keep_id"), "group_size")
    nth = F.row_number().over(Window.partitionBy("digest", "check", "doc_id").orderBy(F.desc("size")))
    return rows.withColumn("nth", nth).join(winners, (F.col("digest") == F.col("d")) & (F.col("check") == F.col("c"))).withColumns(
        {"kept": F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1), "text_sha256": F.lower(F.hex("digest"))}
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: row (a struct of its columns), doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after white space is deleted; null counts as empty. Of equal texts the row with
    the most code points stays, then that with the smallest id, null ids last; of rows repeated with one id and equal texts
    the longest stays, and of wholly equal rows exactly one. An empty table gives an empty result.
    """
    rows = digests(packed(docs, id_col, text_col)).drop("text")
    return decide(rows).select("row", "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    slim = stash(digests(docs).drop("text"), "digests")
    return decide(slim).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
