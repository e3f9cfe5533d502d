"""Substring deduplication over words, by prefix-partitioned suffix trees.

Windows that share a prefix, at first a gram of half a window, meet in one memory-sized group (repeats.py); where a prefix has
too many contexts, it is lengthened word by word as far as needed, at most to the window. In a group, suffixes in order with
their longest common prefixes form a subtree: intervals whose neighbours share at least 50 words are its deep internal nodes,
the repeats, and the smallest document below a node keeps its window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import bytes_of, ids_and_bytes, with_null_ids
from skein.llm.repeats import Kind, merged_spans, with_spans
from skein.sources.tables import table

WINDOW = 50


def dedup_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the other words, joined by one space) of each row of docs.

    A word goes if a window of so many words that covers it also starts in a document with a smaller id; windows are judged
    on the input. Words are compared by 64-bit hashes, a window by all of them. Null is a text without words; null ids count
    as the largest and, like repeated rows of one id, are not smaller than each other; an empty table gives an empty result.
    """
    kind = Kind(window // 2, window - window // 2 + 1, "document", True)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            n, removed, kept = [], [], []
            for text, cell in zip(bytes_of(batch.column(2)), batch.column(3), strict=True):
                words = bytes(text).split()
                lo, hi = merged_spans(cell)
                n.append(len(words))
                removed.append(int((hi - lo).sum()))
                edges = [0, *np.column_stack([lo, hi]).ravel().tolist(), len(words)]
                kept.append(b" ".join(w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return with_null_ids(with_spans(ids_and_bytes(docs, id_col, text_col), kind).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(i)
), c AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM g) WHERE least < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM c) GROUP BY 1
), v AS (
  SELECT d.doc_id, w, coalesce(len(p), 0) AS n_removed, p FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id
), k AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) t
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(p) AS p FROM gone) z WHERE z.doc_id = t.doc_id AND z.p = t.i) GROUP BY 1
)
SELECT v.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM v LEFT JOIN k ON k.doc_id = v.doc_id
"""
