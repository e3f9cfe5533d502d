"""Retrieval for a batch of queries in one plan: keyword lane, dense lane, fusion, reranking and narrowing.

Ranked lists are DataFrames (query_id, chunk_id, rank); ties go by chunk_id everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.stemming import stem, stem_word
from skein.functions.text import STOP_WORDS, cover_density, search_text, term_rows, web_query, words
from skein.functions.vectors import cosine_distance

TOP = 50
RRF = 60
#: Queries of a block and vectors of a slab: what one task of the dense lane holds, however large the corpus is; queries of one product.
BLOCK, SLAB, AT_ONCE = 4096, 20_000, 64


def ranked(scored: DataFrame, n: int = TOP, score: str = "score") -> DataFrame:
    """The n best of each query with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(score), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def postings(chunks: DataFrame, stemmed: bool = True, only: DataFrame | None = None) -> DataFrame:
    """The inverted index: one row for each term of each chunk with its places in order. Write it out, partitioned by term hash, to search often.

    only: a table with the terms that will be looked up; no others are indexed, nor shuffled.
    """
    text = search_text(F.col("raw_text"), F.col("context_text")) if "context_text" in chunks.columns else F.col("raw_text")
    rows = term_rows(chunks.select("chunk_id", text.alias("_text")), F.col("_text")).drop("_text")
    if stemmed:
        rows = rows.withColumn("term", stem("term"))
    if only is not None:
        rows = rows.join(only.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", "chunk_id").agg(F.sort_array(F.collect_list("pos")).alias("places"))


CLAUSES = "query_id {}, n_clauses int, clause int, negated boolean, phrase int, size int, place int, term string, single boolean"


def clauses_of(text: str, stemmed: bool = True) -> list[tuple[frozenset, bool]]:
    """The different clauses of a query, negated ones last: phrases as tuples of (place, word) without stop words, and whether negated."""
    out: dict[tuple, None] = {}
    for c in web_query(text):
        phrases = [tuple((i, stem_word(w) if stemmed else w) for i, w in enumerate(p) if w not in STOP_WORDS) for p in c.phrases]
        if kept := frozenset(p for p in phrases if p):
            out[kept, c.negated] = None
    return sorted(out, key=lambda c: c[1])


def plain(queries: DataFrame) -> DataFrame:
    """Queries whose text is plain words, as queries in web-search syntax: no ``or``, sign or quotation mark of theirs is syntax."""
    return queries.withColumn("query", F.array_join(F.array_remove(words(F.col("query")), "or"), " "))  # a stop word


def query_terms(queries: DataFrame, stemmed: bool = True) -> DataFrame:
    """The terms of queries in web-search syntax (text.web_query): one row for each word of each phrase of each different clause.

    n_clauses counts those that must hold; place is the word's in its phrase, stop words counted but left out; single: the
    clause is one word that must hold. A query without such clauses has no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for qid, text in zip(f["query_id"], f["query"], strict=True):
                clauses = clauses_of(text or "", stemmed)
                n = sum(not negated for _, negated in clauses)
                for i, (phrases, negated) in enumerate(clauses if n else []):
                    single = not negated and len(phrases) == 1 and len(next(iter(phrases))) == 1
                    rows += [(qid, n, i, negated, j, len(p), at, w, single) for j, p in enumerate(sorted(phrases)) for at, w in p]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CLAUSES.split(", ")])

    return queries.select("query_id", "query").mapInPandas(run, CLAUSES.format(queries.schema["query_id"].dataType.simpleString()))


def _phrases(parts):
    """Of an array of struct(clause, phrase, size, negated, starts): the clauses that hold, as structs (clause, negated)."""
    same = lambda p, q: (p["clause"] == q["clause"]) & (p["phrase"] == q["phrase"])
    names = F.array_distinct(F.transform(parts, lambda p: F.struct(p["clause"], p["phrase"], p["size"], p["negated"])))

    def holds(n):
        own = F.transform(F.filter(parts, lambda p: same(p, n)), lambda p: p["starts"])
        # all its words stand at the distances they have in the phrase
        return (F.size(own) == n["size"]) & (F.size(F.aggregate(own, F.get(own, 0), lambda a, x: F.array_intersect(a, x))) > 0)

    return F.array_distinct(F.transform(F.filter(names, holds), lambda n: F.struct(n["clause"], n["negated"])))


PAIR = ["query_id", "chunk_id"]


def _hits(index: DataFrame, queries: DataFrame, within: DataFrame | None, stemmed: bool) -> DataFrame:
    """The postings of the queries' terms."""
    if within is not None:
        index = index.join(within.select("chunk_id").distinct(), "chunk_id", "left_semi")
    hits = index.join(query_terms(queries, stemmed), "term")
    return hits.join(within.select(*PAIR).distinct(), PAIR, "left_semi") if within is not None and "query_id" in within.columns else hits


def matches(index: DataFrame, queries: DataFrame, within: DataFrame | None = None, stemmed: bool = True) -> DataFrame:
    """(query_id, chunk_id, matched, occurrences, n_clauses) of chunks with any word of a query and none of its negated clauses.

    Words are counted in one aggregate over the postings; places travel only for phrases and alternatives.
    """
    hits, pair = _hits(index, queries, within, stemmed), PAIR
    many = F.size("places").cast("long")
    single = hits.where("single").groupBy(*pair).agg(F.count("*").alias("matched"), F.sum(many).alias("found"), F.max("n_clauses").alias("n1"))
    starts = F.transform("places", lambda p: p - F.col("place"))
    other = hits.where("not single").groupBy(*pair).agg(F.collect_list(F.struct("clause", "phrase", "size", "negated", starts.alias("starts"))).alias("parts"), F.sum(F.when(~F.col("negated"), many)).alias("also"), F.max("n_clauses").alias("n2"))
    other = other.withColumn("held", _phrases(F.col("parts"))).drop("parts")
    both = single.join(other, pair, "full").where(~F.coalesce(F.exists("held", lambda h: h["negated"]), F.lit(False)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        *pair, (zero(F.col("matched")) + zero(F.size("held"))).alias("matched"), (zero(F.col("found")) + zero(F.col("also"))).alias("occurrences"), F.coalesce("n1", "n2").alias("n_clauses")
    ).where("occurrences > 0")


def keyword_search(index: DataFrame, queries: DataFrame, n: int = TOP, within: DataFrame | None = None, stemmed: bool = True) -> DataFrame:
    """Ranked lists by words: chunks in which all clauses of a query hold, or, where there is none, chunks with any of its words.

    Queries may have "quoted phrases", ``or`` and ``-``. Chunks in which all clauses hold are scored by cover density, the others
    by a tenth of their occurrences; chunks with a negated clause are never found. ``within`` (query_id, chunk_id) or (chunk_id)
    limits the search. A query without words finds nothing.
    """
    pair, both = PAIR, matches(index, queries, within, stemmed)
    whole = both.where("matched = n_clauses").select(*pair)
    strict = whole.select(F.col("query_id").alias("q")).distinct()
    some = both.join(strict, F.col("query_id") == F.col("q"), "left_anti").select(*pair, (F.col("occurrences") * 0.1).alias("score"))
    places = _hits(index, queries, within, stemmed).where("not negated").join(whole, pair, "left_semi").groupBy(*pair).agg(F.max("n_clauses").alias("n_clauses"), F.collect_list(F.struct("clause", "places")).alias("parts"))
    at = F.array_sort(F.array_distinct(F.flatten(F.transform("parts", lambda t: F.transform(t["places"], lambda p: F.struct(p.alias("pos"), t["clause"].alias("nth")))))))
    # a column of its own, as the fold looks back at it
    every = places.withColumn("at", at).select(*pair, cover_density(F.col("at"), F.col("n_clauses")).alias("score"))
    return ranked(every.unionByName(some).withColumn("score", F.round("score", 9)), n)


def web_search(chunks: DataFrame, query: str, stemmed: bool = True) -> DataFrame:
    """Chunks in which all clauses of one query hold; a query without words matches nothing."""
    q = query_terms(chunks.sparkSession.createDataFrame([(0, query)], "query_id int, query string"), stemmed)
    hits = postings(chunks, stemmed, only=q).join(q, "term")
    starts = F.transform("places", lambda p: p - F.col("place"))
    held = hits.groupBy("chunk_id").agg(F.max("n_clauses").alias("n"), F.collect_list(F.struct("clause", "phrase", "size", "negated", starts.alias("starts"))).alias("parts")).withColumn("held", _phrases(F.col("parts")))
    found = held.where((F.size("held") == F.col("n")) & ~F.exists("held", lambda h: h["negated"]))
    return chunks.join(found.select("chunk_id"), "chunk_id", "left_semi")


def unit(column: pa.ListArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that have that many numbers and a length, and these as doubles of length one."""
    at = np.flatnonzero((np.diff(column.offsets.to_numpy()) == length) & column.is_valid().to_numpy(zero_copy_only=False))
    m = np.asarray(column.values, np.float64)[column.offsets.to_numpy()[at][:, None] + np.arange(length)]
    size = np.sqrt((m * m).sum(1))
    ok = size > 0
    return at[ok], m[ok] / size[ok, None]


def best_of(n: int):
    """A step of a cogroup: the n best vectors (chunk_id, embedding) of a slab for each query (query_id, qv) of a block, by products of some queries at a time."""

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if left.num_rows and right.num_rows:
            qids, ids = left["query_id"].to_numpy(), right["chunk_id"].to_numpy()
            asked, have = left["qv"].combine_chunks(), right["embedding"].combine_chunks()
            for length in np.unique(np.diff(asked.offsets.to_numpy())).tolist():
                (i, a), (j, b) = unit(asked, length), unit(have, length)
                for lo in range(0, len(i) if len(j) else 0, AT_ONCE):
                    for k, score in zip(i[lo : lo + AT_ONCE], np.round(a[lo : lo + AT_ONCE] @ b.T, 12), strict=True):
                        # a tie at the n-th place goes by id, so all that tie are kept first
                        near = np.flatnonzero(score >= np.partition(score, -n)[-n]) if len(score) > n else np.arange(len(score))
                        best = near[np.lexsort((ids[j[near]], -score[near]))][:n]
                        out.append((np.full(len(best), qids[k]), ids[j[best]], score[best]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "chunk_id", "score"])

    return product


def dense_search(vectors: DataFrame, queries: DataFrame, n: int = TOP, within: DataFrame | None = None, block: int = BLOCK, slab: int = SLAB) -> DataFrame:
    """Ranked lists by exact cosine: vectors (chunk_id, embedding) against queries (query_id, embedding).

    Queries are dealt into blocks and vectors into slabs, by two counts of column data alone; each pair of a block and a slab meets in
    one task, which returns its n best of each query, so what is shuffled next is n rows for each query and slab. A vector travels
    once for each block of queries; clusters.search reads fewer. Vectors of another length than the query's, without length or null
    are not found.
    """
    if within is not None:
        vectors = vectors.join(within.select("chunk_id").distinct(), "chunk_id", "left_semi")
    known = vectors.where(F.col("embedding").isNotNull())
    blocks, slabs = (max(1, -(-c // size)) for c, size in ((queries.count(), block), (known.count(), slab)))
    q = queries.select("query_id", F.col("embedding").alias("qv"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("b")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
    v = known.select("chunk_id", "embedding", F.pmod(F.xxhash64("chunk_id"), F.lit(slabs)).cast("int").alias("s")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return ranked(q.groupBy("b", "s").cogroup(v.groupBy("b", "s")).applyInArrow(best_of(n), "query_id bigint, chunk_id bigint, score double"), n)


def dense_within(vectors: DataFrame, queries: DataFrame, pairs: DataFrame, n: int = TOP) -> DataFrame:
    """dense_search where each query has its own chunks: ``pairs`` (query_id, chunk_id), which are scored one by one."""
    asked = queries.select("query_id", F.col("embedding").alias("qv")).join(pairs.select("query_id", "chunk_id").distinct(), "query_id")
    scored = asked.join(vectors.select("chunk_id", "embedding"), "chunk_id").select("query_id", "chunk_id", F.round(1 - cosine_distance(F.col("embedding"), F.col("qv")), 12).alias("score"))
    return ranked(scored.where(F.col("score").isNotNull()), n)


def fuse(keyword: DataFrame, dense: DataFrame, n: int = TOP, k: int = RRF) -> DataFrame:
    """Reciprocal-rank fusion: (query_id, chunk_id, score, keyword_rank, dense_rank, rank)."""
    a = keyword.select("query_id", "chunk_id", F.col("rank").alias("keyword_rank"))
    b = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    part = lambda c: F.coalesce(1 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    both = a.join(b, ["query_id", "chunk_id"], "full").withColumn("score", F.round(part("keyword_rank") + part("dense_rank"), 12))
    return ranked(both, n)


def overlap(query: Column, text: Column) -> Column:
    """The default reranker: the share of the query's words, split at blanks, that the text has."""
    of = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    return F.try_divide(F.size(F.array_intersect(of(query), of(text))).cast("double"), F.size(of(query)))


def _overlaps(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """overlap() of query and text, both in lower case and as bytes, which split at the same blanks; the text's words are looked up as they come."""
    for batch in parts:
        score = []
        for query, text in zip(batch["query"].to_pylist(), batch["text"].to_pylist(), strict=True):
            asked = set(query.split())
            score.append(len(asked.intersection(text.split())) / len(asked) if asked else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score, pa.float64())], names=["query_id", "chunk_id", "was", "score"])


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, n: int = 6, scorer: Callable[[pd.Series, pd.Series], pd.Series] | Callable[[Column, Column], Column] | None = overlap) -> DataFrame:
    """The n best candidates by a scorer of (query, context and text): overlap, an injected model over series, or none, which keeps the candidates as they are ranked.

    A missing score counts as 0; ties keep the candidates' order.
    """
    if scorer is None:
        return candidates.where(F.col("rank") <= n).select("query_id", "chunk_id", "rank", "score")
    text = search_text(F.col("raw_text"), F.col("context_text")) if "context_text" in chunks.columns else F.col("raw_text")
    rows = candidates.select("query_id", "chunk_id", F.col("rank").alias("was")).join(queries.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", text.alias("text")), "chunk_id", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f[["query_id", "chunk_id", "was"]].assign(score=np.asarray(scorer(f["query"], f["text"]), float))

    if scorer is overlap:
        low = lambda c: F.lower(F.coalesce(c, F.lit(""))).cast("binary").alias(c)
        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("query_id", "chunk_id", "was"))
        scored = rows.select("query_id", "chunk_id", "was", low("query"), low("text")).mapInArrow(_overlaps, f"{kinds}, score double")
    else:
        scored = rows.mapInPandas(run, "query_id bigint, chunk_id bigint, was int, score double")
    scored = scored.withColumn("score", F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "was", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query_id", "chunk_id", "rank", "score")


def narrowed(chunks: DataFrame, found: DataFrame, open_if_empty: bool = True) -> DataFrame:
    """Chunks of the jobs found; all chunks where ``found`` has no job_id, or no rows and ``open_if_empty``."""
    if "job_id" not in found.columns:
        return chunks
    jobs = found.select("job_id").where(F.col("job_id").isNotNull()).distinct()
    if open_if_empty and jobs.isEmpty():
        return chunks
    return chunks.join(jobs, "job_id", "left_semi")


def in_order(ranked_ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks' rows in the order of their ranks."""
    return ranked_ids.select("query_id", "chunk_id", "rank").join(chunks, "chunk_id").orderBy("query_id", "rank")
