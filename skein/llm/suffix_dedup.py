"""Exact substring deduplication over bytes, by suffix arrays.

repeats.py brings together the different contexts in which a repeated anchor stands; their suffixes are ordered, and the
previous and next smaller positions in suffix order (longest-previous-factor arrays) say which 200-byte strings start earlier
too. A context that occurs more than once is laid down twice, so that its repeat shows in suffix order like any other.
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

LENGTH = 200


def dedup_substrings(docs: DataFrame, length: int = LENGTH, keep: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of each row of docs.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else (keep="none"), or at a smaller id or
    an earlier place of the same text (keep="first"). Strings are judged on the input and do not cross texts. Null is an empty
    text; null ids count as the largest; repeated rows are copies of each other like any others (with keep="first", rows equal
    in id and text share their spans, so both keep what is first there); an empty table gives an empty result.
    """
    kind = Kind(length // 2, length - length // 2 + 1, keep, False)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            n, removed, spans, kept = [], [], [], []
            for text, cell in zip(bytes_of(batch.column(2)), batch.column(3), strict=True):
                lo, hi = merged_spans(cell)
                n.append(len(text))
                removed.append(int((hi - lo).sum()))
                spans.append(len(lo))
                edges = [0, *np.column_stack([lo, hi]).ravel().tolist(), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return with_null_ids(with_spans(ids_and_bytes(docs, id_col, text_col), kind).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"), LENGTH, "none")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (
  SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 400)) AS h FROM d, unnest(range(0, n - 199)) AS t(i) WHERE n >= 200
), c AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM w
), s AS (
  SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 AS goes_on FROM c WHERE c > 1
), g AS (
  SELECT doc_id, i, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s
), r AS (
  SELECT doc_id, run, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY ALL
), a AS (
  SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM r GROUP BY 1
), e AS (
  SELECT d.doc_id, n, x, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, list_concat([0], coalesce(his, [])) AS f, list_concat(coalesce(los, []), [n]) AS t FROM d LEFT JOIN a ON a.doc_id = d.doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(unhex(array_to_string([substr(x, 2 * f[k] + 1, 2 * (t[k] - f[k])) FOR k IN range(1, len(f) + 1)], ''))) AS kept_sha256
FROM e
"""
