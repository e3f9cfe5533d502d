"""N-gram Jaccard self-join of documents with Bayesian candidate pruning.

A document is the set of its five-word shingles. Documents of one set are one class. Classes that share a MinHash band become
candidates; pairs are dropped as soon as the posterior probability that they reach the threshold falls below the tolerance,
and the rest are verified on the whole sets (similar.py). With 40 bands of 5 values a pair at the threshold of 0.8 shares none
with probability 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import kernels as K
from skein.llm import similar as S
from skein.llm.common import NO_ID, batches, bytes_of, column_np, ids_and_bytes, stash, with_null_ids
from skein.sources.tables import table

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 40, 5


def shingles(text, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; a shorter text with words is one shingle."""
    values = K.word_hashes(np.frombuffer(text, np.uint8))[2]
    return np.unique(K.window_hashes(values, min(words, len(values)))) if len(values) else values


CLASS_ARROW = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("id", pa.int64()), ("check", pa.int64()), ("bands", pa.binary())])


def _classes(words: int, bands: int, rows: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = list(bytes_of(batch.column(2)))
            doc, th = column_np(batch, "doc_id"), column_np(batch, "th")
            for at in range(0, len(texts), 500):
                sets = [shingles(t, words) for t in texts[at : at + 500]]
                size = np.array([len(s) for s in sets])
                full = np.flatnonzero(size)
                ids, check, keys = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64), [None] * len(sets)
                for group in np.array_split(full, max(1, int(size.sum()) // 200_000)):
                    if not len(group):
                        continue
                    flat, start = np.concatenate([sets[g] for g in group]), np.cumsum(size[group]) - size[group]
                    ids[group] = K.mix(np.add.reduceat(K.mix(flat), start) + size[group].astype(np.uint64))
                    check[group] = np.add.reduceat(K.mix(flat ^ np.uint64(0x5555555555555555)), start)
                    for g, v in zip(group.tolist(), S.band_values(S.signatures(flat, start, bands * rows), rows), strict=True):
                        keys[g] = v.tobytes()
                stop = at + len(sets)
                yield from batches(CLASS_ARROW, [doc[at:stop], th[at:stop], ids.view(np.int64), check.view(np.int64), keys])

    return run


def _exploded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("band", pa.int64()), ("id", pa.int64())])
    for batch in parts:
        ids = column_np(batch, "id")
        values = [np.frombuffer(v, np.int64) for v in bytes_of(batch.column(1))]
        if values:
            yield from batches(schema, [np.concatenate(values), np.repeat(ids, [len(v) for v in values])])


def _sets(words: int):
    schema = pa.schema([("root", pa.int64()), ("id", pa.int64()), ("weight", pa.int64()), ("body", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, len(batch), 500):
                b = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([shingles(t, words).tobytes() for t in bytes_of(b.column(3))], pa.binary())], schema=schema)

    return run


def ngram_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, th, copy_id, class_id, n_links, n_text_links and first.

    copy_id: the smallest id with the same shingles; class_id: the smallest id that links lead to; n_links: other documents
    with similarity of at least the threshold, copies included; n_text_links: other shingle sets among them; first: whether
    the row is the one of its class to keep (of the smallest id; of wholly repeated rows all have the same answer). A text
    without words (null, empty, blank) has no links, not even to its like. Null ids count as the largest. Texts of any length
    are read whole; an empty table gives an empty result.
    """
    docs = ids_and_bytes(docs, id_col, text_col)
    each = stash(docs.mapInArrow(_classes(words, bands, rows), "doc_id long, th long, id long, check long, bands binary"), "classes")
    named = each.where("bands is not null")
    classes = stash(named.groupBy("id", "check").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.count("*").alias("weight"), F.first("bands").alias("bands")), "sets")
    edges = S.bucket_edges(classes.select("id", "bands"), _exploded, bands * classes.count())
    roots = stash(S.components(edges), "candidates")
    members = roots.groupBy("root").agg(F.count("*").alias("members"))
    chosen = classes.join(roots, "id").select("root", "id", "weight", "rep.*")
    sets = stash(docs.join(chosen, ["doc_id", "th"]).select("root", "id", "weight", "text").mapInArrow(_sets(words), S.SETS), "shingles")
    found = stash(S.verify(sets, bands * rows, threshold, members), "links")
    linked = found.groupBy("id").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked"))
    final = S.components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "groups")
    info = classes.select("id", "check", "rep", "weight").join(linked, "id", "left").join(final, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = info.groupBy("root").agg(F.min("rep").alias("least"))
    info = info.join(least, "root").select("id", "check", "rep", "least", "weight", "links", "linked")
    out = each.drop("bands").join(info, ["id", "check"], "left")
    return out.select(
        "doc_id", "th", F.coalesce("rep.doc_id", "doc_id").alias("copy_id"), F.coalesce("least.doc_id", "doc_id").alias("class_id"),
        (F.coalesce(F.col("weight") - 1, F.lit(0)) + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("links", F.lit(0)).cast("long").alias("n_text_links"),
        F.coalesce((F.col("doc_id") == F.col("least.doc_id")) & (F.col("th") == F.col("least.th")), F.lit(True)).alias("first"),
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return with_null_ids(found).select("doc_id", null("copy_id"), null("class_id"), "n_links", "n_text_links")


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct([md5(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) FOR i IN range(1, len(w) - least(5, len(w)) + 2)])) AS g FROM d WHERE len(w) > 0
), c AS (
  SELECT min(doc_id) AS id, any_value(g) AS g, len(any_value(g)) AS n, count(*) AS weight FROM s GROUP BY md5(array_to_string(g, ''))
), x AS (SELECT id, n, weight, unnest(g) AS h FROM c),
p AS (
  SELECT a.id AS a, b.id AS b, any_value(b.weight) AS weight FROM x a JOIN x b ON a.h = b.h AND a.id <> b.id AND a.n * 10 >= b.n * 8 AND b.n * 10 >= a.n * 8
  GROUP BY a.id, b.id HAVING count(*) * 10 >= 8 * (any_value(a.n) + any_value(b.n) - count(*))
), r(id, root) AS (SELECT id, id FROM c UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id),
k AS (SELECT id, min(root) AS class_id FROM r GROUP BY 1),
l AS (SELECT a AS id, count(*) AS texts, sum(weight) AS docs FROM p GROUP BY 1),
m AS (SELECT s.doc_id, c.id, c.weight FROM s JOIN c ON c.g = s.g)
SELECT d.doc_id, coalesce(m.id, d.doc_id) AS copy_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(weight - 1, 0) + coalesce(docs, 0) AS BIGINT) AS n_links, CAST(coalesce(texts, 0) AS BIGINT) AS n_text_links
FROM d LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN k ON k.id = m.id LEFT JOIN l ON l.id = m.id
"""
