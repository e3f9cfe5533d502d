"""Quality classification with supervised subword embeddings.

A document is the mean of the learned vectors of its words, of its pairs of neighbouring words, of the n-grams of 3 to 5 bytes
inside words (each word between < and >), and of how long ago each word stood last (a relative word n-gram, which holds for
words that training never saw), all hashed into BUCKETS; a softmax over the two labels follows. Vectors and
output are learned together by numpy stochastic gradient descent, one document a step, on at most SAMPLE labelled documents of
any length (those of the smallest hashes). As a mean is linear, each bucket's vector meets the output once, and scoring adds
one number a feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm import kernels as K
from skein.llm.common import bytes_of, held_out, packed
from skein.sources.tables import table

BUCKETS, DIM, EPOCHS, RATE = 1 << 17, 8, 12, 1.0
SAMPLE = 6000
ORDERS = (3, 4, 5)
_MARKS = np.array([ord("<"), ord(">")], np.uint8)


def since(hashes: np.ndarray) -> np.ndarray:
    """For each word how many words ago it stood last, as the power of two not below it; 0 where it is new."""
    order = np.argsort(hashes, kind="stable")
    again = hashes[order[1:]] == hashes[order[:-1]]
    out = np.zeros(len(hashes), np.uint64)
    out[order[1:][again]] = 1 + np.ceil(np.log2((order[1:] - order[:-1])[again])).astype(np.uint64)
    return out


def features(text: bytes) -> np.ndarray:
    """Buckets of the text's words, word pairs, recurrences and word-internal n-grams; empty for a text without words."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, hashes = K.word_hashes(data)
    if not len(starts):
        return np.empty(0, np.int64)
    # the words one after another, each between < and >
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes + 2)])
    marked = np.empty(at[-1], np.uint8)
    marked[at[:-1]], marked[at[1:] - 1] = _MARKS
    word = np.repeat(np.arange(len(sizes)), sizes)
    marked[np.arange(len(word)) + 2 * word + 1] = data[starts[word] + np.arange(len(word)) - (np.cumsum(sizes) - sizes)[word]]
    home = np.repeat(np.arange(len(sizes)), sizes + 2)
    pairs = K.mix(hashes[:-1] * np.uint64(3) + hashes[1:])
    out, code, wide = [hashes >> np.uint64(64 - 17), pairs >> np.uint64(64 - 17), K.mix(since(hashes)) >> np.uint64(64 - 17)], np.zeros(len(marked), np.uint64), marked.astype(np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > len(marked):
            break
        code = (code[: len(marked) - n + 1] << np.uint64(8)) | wide[n - 1 :]
        if n in ORDERS:
            inside = home[: len(home) - n + 1] == home[n - 1 :]
            out.append(((code[inside] + np.uint64(n << 48)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17))
    return np.concatenate(out).astype(np.int64)


def counted(text) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets of a text of any length and how often each is hit."""
    times = np.zeros(BUCKETS, np.int64)
    for at in pieces(text):
        times += np.bincount(features(text[at]), minlength=BUCKETS)
    ids = np.flatnonzero(times)
    return ids.astype(np.int32), times[ids].astype(np.float32)


def train(texts: list, labels: list[int], seed: int = 5) -> np.ndarray:
    """The score's log odds that each bucket adds (before the mean), as BUCKETS numbers, then the bias; texts: bytes or counted()."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    output, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    rows = []
    for t in texts:
        ids, n = t if isinstance(t, tuple) else counted(t)
        rows.append((ids, n / max(1, n.sum())))
    total, done = EPOCHS * max(1, len(rows)), 0
    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            ids, share = rows[r]
            own = vectors[ids]
            x = share @ own
            z = x @ output + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[labels[r]] -= 1
            rate = RATE * (1 - done / total)
            vectors[ids] = own - (rate * share)[:, None] * (output @ g)
            output -= rate * np.outer(x, g)
            bias -= 0.1 * rate * g
            done += 1
    side = output[:, 1] - output[:, 0]
    return np.append(vectors @ side, bias[1] - bias[0]).astype(np.float32)


def _counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text, or where that is shorter, which is for long texts, its counted features."""
    for batch in parts:
        for k, text in enumerate(bytes_of(batch.column(1))):
            ids, n = counted(text)
            short = len(text) < ids.nbytes + n.nbytes
            cells = (bytes(text), None, None) if short else (None, ids.tobytes(), n.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).select(["d", "y"]).columns, *(pa.array([c], pa.binary()) for c in cells)], names=["d", "y", "t", "ids", "n"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Learns from a bounded sample of the labelled rows; rows without an id, a label or a text are not taken.

    Of labels that differ for one id the greater counts, and rows equal in id and text count once. Features are counted in Spark
    tasks, at most BUCKETS of them for a text however long.
    """
    marks = labels.where(F.col(f"`{label_col}`").isin(0, 1)).groupBy(F.col(f"`{id_col}`").alias("i")).agg(F.max(f"`{label_col}`").cast("int").alias("y"))
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("d"), text.cast("binary").alias("t"), F.xxhash64(text).alias("th")).where(F.col("d").isNotNull() & text.isNotNull())
    chosen = rows.select("d", "th").join(marks, F.col("d") == F.col("i")).select("d", "th", "y").distinct().orderBy(F.xxhash64("d", "th", F.lit(2)), "d", "th").limit(sample)
    # at most ``sample`` rows
    got = rows.join(F.broadcast(chosen), ["d", "th"]).dropDuplicates(["d", "th"]).select("d", "t", "y").mapInArrow(_counts, f"d {rows.schema['d'].dataType.simpleString()}, y int, t binary, ids binary, n binary").collect()
    got = sorted(((r["d"], bytes(r["t"] or b""), bytes(r["ids"] or b""), bytes(r["n"] or b""), r["y"]) for r in got))
    return train([(np.frombuffer(i, np.int32), np.frombuffer(n, np.float32)) if i else t for _, t, i, n, _ in got], [y for *_, y in got])


def score(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (probability of label 1) of each row; a null, empty or blank text has no feature and gets the bias alone.

    Texts are read whole, repeated rows get equal scores, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = packed(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in parts:
            z = np.empty(len(batch))
            for i, t in enumerate(bytes_of(batch.column(1))):
                total, n = 0.0, 0
                for at in pieces(t):
                    f = features(t[at])
                    total, n = total + float(m[f].sum(dtype=np.float64)), n + len(f)
                z[i] = m[-1] + total / max(1, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    return slim.mapInArrow(run, T.StructType([slim.schema.fields[0], T.StructField("score", T.DoubleType())]))


def pieces(text, size: int = K.PIECE) -> list[slice]:
    """Slices of a long text that end at blanks where there are any, so that no word is cut unless it is longer than a piece."""
    out, at = [], 0
    while len(text) - at > size:
        cut = max(bytes(text[at : at + size]).rfind(b" "), 0) or size
        out.append(slice(at, at + cut))
        at += cut
    return [*out, slice(at, len(text))]


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit(docs.where(~held_out("doc_id", 5, 0)), labels)
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
