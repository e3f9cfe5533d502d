"""What the operators share: inputs, written tables and Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.sources.tables import put

#: The white space of the contracts: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
#: Stands for a null id where ids are compared.
NO_ID = (1 << 63) - 1


def written(df: DataFrame, name: str, by: str | None = None) -> tuple[DataFrame, str]:
    """``df`` as a table written to the shared folder (in folders ``by`` a column), so that a lost executor costs no recomputation, and its path."""
    path = put(df, name, by)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stash(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder that stays, as a result still reads it; whoever owns the folder clears it."""
    return written(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``row`` (all of docs, so that no name of theirs can clash), ``doc_id`` and ``text``."""
    return docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        docs[f"`{id_col}`"].alias("doc_id"),
        docs[f"`{text_col}`"].alias("text"),
    )


def ids_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (null as NO_ID), ``th`` (a hash of the text: with doc_id it names a row's content) and ``text`` as bytes, null as empty.

    Ids are whole numbers; others raise TypeError. The largest long is the one that may not be an id, as it stands for null.
    """
    text, ids = F.coalesce(docs[f"`{text_col}`"], F.lit("")), docs[f"`{id_col}`"]
    if not isinstance(docs.schema[id_col].dataType, (T.IntegralType, T.NullType)):
        raise TypeError(f"ids must be whole numbers, not {docs.schema[id_col].dataType.simpleString()}")
    checked = F.when(ids.cast("long") == NO_ID, F.raise_error(F.lit("an id is the largest long, which stands for null"))).otherwise(F.coalesce(ids.cast("long"), F.lit(NO_ID)))
    return docs.select(checked.alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))


def with_null_ids(df: DataFrame) -> DataFrame:
    """``df`` with NO_ID as null again."""
    return df.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def held_out(doc_id: str, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod == rest


def bytes_of(column: pa.ChunkedArray | pa.Array) -> Iterator[memoryview]:
    """Each binary value without a copy; null as empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for chunk in chunks:
        if len(chunk) == 0:
            continue
        wide = pa.types.is_large_binary(chunk.type) or pa.types.is_large_string(chunk.type)
        _, offs, data = chunk.buffers()
        at = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        view = memoryview(data) if data is not None else memoryview(b"")
        valid = chunk.is_valid().to_pylist() if chunk.null_count else None
        for i in range(len(chunk)):
            yield view[at[i] : at[i + 1]] if valid is None or valid[i] else view[:0]


def column_np(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of numbers as a numpy array; nulls become the largest long."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null(np.iinfo(np.int64).max)
    return col.to_numpy(zero_copy_only=False)


def sliced(n: int, rows: int = 50_000) -> Iterable[slice]:
    """Slices of at most ``rows``, so that no Arrow batch grows large."""
    return (slice(i, min(n, i + rows)) for i in range(0, n, rows))


def batches(schema: pa.Schema, columns: list) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from equally long columns."""
    n = len(columns[0]) if columns else 0
    for s in sliced(n):
        yield pa.RecordBatch.from_arrays([pa.array(c[s], type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
