"""Language identification with string kernels.

A text is the set of its n-grams of 1 to 4 bytes after A-Z are lower-cased and other ASCII marks become blanks (the blended
spectrum, by presence). The kernel of two texts is the cosine of these sets. Nyström landmarks, as many from each language,
span the feature space, and one ridge regression for each language against the rest is fitted in it. As the kernel is linear
in the n-grams, landmarks, whitening and weights fold into one table with a row for each n-gram that a landmark holds; a text's
score is the sum of its n-grams' rows. Others have no weight and do not count. It is fitted on at most PER_LANGUAGE labelled
texts of each language; texts of any length are learned from and scored whole, as sets of n-grams made in Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.llm.common import bytes_of, held_out
from skein.sources.tables import table

PER_LANGUAGE = 400
LANDMARKS, RIDGE, ORDERS, TABLE_BITS = 64, 1e-3, 4, 20
UNKNOWN = "und"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PIECE = 1 << 20


def gram_codes(text: bytes) -> Iterator[np.ndarray]:
    """Hashes (TABLE_BITS bits) of the text's n-grams; a long text comes in overlapping pieces."""
    data = np.frombuffer(bytes(text).translate(_FOLD), np.uint8)
    for at in range(0, max(1, len(data)), PIECE):
        part = data[at : at + PIECE + ORDERS - 1].astype(np.uint64)
        code = np.zeros(len(part), np.uint64)
        for n in range(1, min(ORDERS, len(part)) + 1):
            code = (code[: len(part) - n + 1] << np.uint64(8)) | part[n - 1 :]
            yield ((code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


def gram_set(text: bytes) -> np.ndarray:
    """The different n-grams of a text, however long."""
    seen = np.empty(0, np.uint64)
    for codes in gram_codes(text):
        seen = np.union1d(seen, codes)
    return seen


class Model:
    """slot: each n-gram hash's column or 0; weights: (columns + 1) x languages, row 0 zero."""

    def __init__(self, texts: list[bytes | np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        """texts: bytes or their gram_set()."""
        self.langs = sorted(set(langs))
        sets = [t if isinstance(t, np.ndarray) else gram_set(t) for t in texts]
        at = np.array(langs, object)
        chosen = np.concatenate([np.flatnonzero(at == b)[:landmarks] for b in self.langs]) if self.langs else np.empty(0, np.int64)
        known = np.zeros(1 << TABLE_BITS, bool)
        for i in chosen:
            known[sets[i]] = True
        held = np.flatnonzero(known)
        self.slot = np.zeros(1 << TABLE_BITS, np.int32)
        self.slot[held] = np.arange(1, len(held) + 1)
        self.weights = np.zeros((len(held) + 1, len(self.langs)), np.float32)
        if not self.langs:
            return
        columns = [x[x > 0] for x in (self.slot[s] for s in sets)]
        y = np.array([[1.0 if a == b else -1.0 for b in self.langs] for a in langs])
        # equal weight for each language, however many texts it has
        w = 1 / np.array([langs.count(a) for a in langs])[:, None]
        kernel = np.empty((len(sets), len(chosen)), np.float32)
        for lo in range(0, len(chosen), 64):
            table = np.zeros((len(held) + 1, min(64, len(chosen) - lo)), np.float32)
            for j, i in enumerate(chosen[lo : lo + 64]):
                table[columns[i], j] = 1 / max(1, np.sqrt(len(columns[i])))
            for row, c in zip(kernel, columns, strict=True):
                row[lo : lo + 64] = table[c].sum(0) / max(1, np.sqrt(len(c)))
        values, vectors = np.linalg.eigh(kernel[chosen].astype(np.float64))
        good = values > 1e-6 * values.max() if len(values) and values.max() > 0 else np.zeros(len(values), bool)
        whiten = vectors[:, good] / np.sqrt(values[good])
        phi = kernel @ whiten
        fit = np.linalg.solve(phi.T @ (w * phi) + ridge * np.eye(phi.shape[1]), phi.T @ (w * y)) if good.any() else np.zeros((0, len(self.langs)))
        for i, part in zip(chosen, whiten @ fit, strict=True):
            self.weights[columns[i]] += (part / max(1, np.sqrt(len(columns[i])))).astype(np.float32)

    def _columns(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The columns of the n-grams that each text holds."""
        mark = np.zeros(len(self.weights), bool)
        for t in texts:
            for codes in gram_codes(t):
                mark[self.slot[codes]] = True
            mark[0] = False
            found = np.flatnonzero(mark)
            mark[found] = False
            yield found

    def _unit(self, texts: list[bytes]) -> np.ndarray:
        """The texts as rows of length one."""
        x = np.zeros((len(texts), len(self.weights)), np.float32)
        for row, c in zip(x, self._columns(texts), strict=True):
            row[c] = 1 / max(1, np.sqrt(len(c)))
        return x

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language of each text and its score: where the regression lies between rest (0) and it (1)."""
        s = np.array([self.weights[c].sum(0) / max(1, np.sqrt(len(c))) for c in self._columns(texts)]).reshape(len(texts), -1)
        best = s.argmax(1)
        return best, np.clip((s[np.arange(len(s)), best].astype(float) + 1) / 2, 0, 1)


def _gram_sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        for k, text in enumerate(bytes_of(batch.column(1))):
            row = batch.slice(k, 1)
            yield pa.RecordBatch.from_arrays([row.column(0), pa.array([gram_set(text).astype(np.int32).tobytes()], pa.binary()), row.column(2)], names=["i", "t", "l"])


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """A model of a bounded sample of the labelled rows: those of the smallest hashes of each language.

    Rows equal in id, text and language count once. Rows whose hash is beyond four times the share wanted of their language are
    out before anything is ranked, so that few rows of a language meet in a task however many it has.
    """
    known = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").rlike(r"\p{L}"))
    h = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.lit(1))
    rows = known.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("binary").alias("t"), F.col(f"`{lang_col}`").alias("l"), h.alias("h"))
    share = known.groupBy(F.col(f"`{lang_col}`").alias("m")).agg(F.approx_count_distinct(h).alias("n")).select("m", F.least(F.lit(1.0), (4.0 * per_language + 200) / F.col("n")).alias("share"))
    place = (F.col("h") / F.lit(2.0**63) + 1) / 2  # from 0 to 1
    near = rows.join(share, F.col("l") == F.col("m")).where(place <= F.col("share")).select("i", "t", "l", "h").dropDuplicates(["l", "h"])
    nth = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    # sets of at most 2^TABLE_BITS n-grams, however long the texts are
    got = near.withColumn("nth", nth).where(F.col("nth") <= per_language).select("i", "t", "l").mapInArrow(_gram_sets, near.select("i", "t", "l").schema)
    rows_ = sorted((str(r["i"]), bytes(r["t"]), r["l"]) for r in got.collect())
    order = np.random.default_rng(3).permutation(len(rows_))
    return Model([np.frombuffer(rows_[k][1], np.int32) for k in order], [rows_[k][2] for k in order])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id (or ``row``, all columns of docs, with carry), lang_pred and score of each row.

    A text that is null or has no letter is ``und`` with score 0, as is every text if no language was learned. A text none of
    whose n-grams is known gets the first language by name with a score of 0.5. Texts of any length are read whole; repeated
    rows get equal results; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    first = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row") if carry else F.col(f"`{id_col}`").alias("doc_id")
    slim = docs.select(first, F.when(text.rlike(r"\p{L}"), text).cast("binary").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in parts:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                column = batch.column(1)
                known = column.is_valid().to_numpy(zero_copy_only=False) & bool(m.langs)
                texts = list(bytes_of(column))
                best, score = m.predict(texts) if m.langs else (np.zeros(len(texts), int), np.zeros(len(texts)))
                names = [m.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], names=[batch.schema.names[0], "lang_pred", "score"])

    return slim.mapInArrow(run, T.StructType([slim.schema.fields[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def learned(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out("doc_id", 3, 1)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, learned(docs))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
