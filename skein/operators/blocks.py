"""A block index for the keyword lane: postings written once, as one row for each term and window of chunks.

Chunks are put in windows of ``size`` by their length, the longest first, so that the chunks with many occurrences stand together. A
row of the index (a block) has a term's chunks in a window with their places, how many there are, the range of their ids and the
most occurrences in one of them. Blocks lie in folders by a hash of the term (and, for very common terms, of runs of SPAN windows),
sorted by term, so that a search reads the folders, row groups and columns it needs.

A search is exact and reads blocks in two rounds: bounds alone first, from the small columns; then the chunks of the windows with
the highest bounds, whose n-th best score is a threshold; then the windows whose bound reaches it. Where all words of a query must
stand in a chunk, only windows that have all of them are read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.stemming import stem
from skein.functions.text import cover_density, search_text, term_rows
from skein.operators.ordering import numbered
from skein.operators.retrieval import TOP, keyword_search, query_terms, ranked
from skein.sources.tables import kept, shared_dir

SHARDS, SIZE, SPAN, FIRST = 16, 64, 4096, 2
PAIR = ["query_id", "chunk_id"]


def windows(chunks: DataFrame, size: int = SIZE) -> DataFrame:
    """chunk_id and window: ``size`` chunks in a window, by length of their text (longest first), then id."""
    sized = chunks.select("chunk_id", (-F.coalesce(F.length(_text(chunks)), F.lit(0))).alias("less"))
    return numbered(sized, ["less", "chunk_id"]).select("chunk_id", F.expr(f"number div {size}").alias("window"))


def _text(chunks: DataFrame):
    return search_text(F.col("raw_text"), F.col("context_text")) if "context_text" in chunks.columns else F.col("raw_text")


def _shard(shards: int, span):
    return F.pmod(F.pmod(F.xxhash64("term"), F.lit(shards)) + span, F.lit(shards)).cast("int")


def _span():
    return F.expr(f"window div {SPAN}")


@dataclass(frozen=True)
class BlockIndex:
    """An index in a folder: blocks (shard, term, window, n, most, lo, hi, and by chunk id: ids, counts, places)."""

    spark: SparkSession
    path: str
    shards: int
    spans: int
    stemmed: bool

    def blocks(self) -> DataFrame:
        return self.spark.read.schema("term string, window long, n int, most int, lo long, hi long, ids array<long>, counts array<int>, places array<array<int>>, shard int").parquet(self.path)

    def postings(self, asked: DataFrame) -> DataFrame:
        """The postings of the terms in ``asked`` as retrieval.postings has them."""
        found = self.blocks().join(asked.select("term").distinct(), "term", "left_semi")
        return found.select("term", F.explode(F.arrays_zip("ids", "places")).alias("c")).select("term", F.col("c.ids").alias("chunk_id"), "c.places")


def build(chunks: DataFrame, path: str | None = None, stemmed: bool = True, only: DataFrame | None = None, shards: int = SHARDS, size: int = SIZE) -> BlockIndex:
    """Writes the index of ``chunks`` (chunk_id, raw_text, perhaps context_text) to ``path``, by default in the shared folder.

    The chunks are exploded into words once, in one shuffle by term and window; no group is larger than the words of a window. Chunk
    ids are whole numbers, each once. only: a table with the terms that will be looked up. shards: the number of folders, to be raised
    with the corpus.
    """
    spark = chunks.sparkSession
    path = path or f"{shared_dir(spark)}/skein-blocks-{uuid.uuid4().hex}"
    spans = max(0, chunks.count() - 1) // size // SPAN + 1
    texts = chunks.select("chunk_id", _text(chunks).alias("text")).join(windows(chunks, size), "chunk_id")
    rows = term_rows(texts, F.col("text")).drop("text")
    if stemmed:
        rows = rows.withColumn("term", stem("term"))
    if only is not None:
        rows = rows.join(only.select("term").distinct(), "term", "left_semi")
    dealt = rows.repartition("term", "window")  # both aggregates below keep it
    by_chunk = dealt.groupBy("term", "window", "chunk_id").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    block = by_chunk.groupBy("term", "window").agg(F.sort_array(F.collect_list(F.struct("chunk_id", F.size("places").alias("count"), "places"))).alias("c"))
    block = block.select("term", "window", F.size("c").alias("n"), F.array_max("c.count").alias("most"), F.get("c.chunk_id", F.lit(0)).alias("lo"), F.element_at("c.chunk_id", -1).alias("hi"), F.col("c.chunk_id").alias("ids"), F.col("c.count").alias("counts"), F.col("c.places").alias("places"))
    block.withColumn("shard", _shard(shards, _span())).sortWithinPartitions("shard", "term", "window").write.partitionBy("shard").parquet(path)
    return BlockIndex(spark, path, shards, spans, stemmed)


def bounds(index: BlockIndex, asked: DataFrame) -> DataFrame:
    """For each query and window with one of its words: bound (no chunk there has more occurrences), present (words found) and n_clauses.

    ``asked``: rows of retrieval.query_terms whose clauses are single words.
    """
    spans = F.explode(F.sequence(F.lit(0), F.lit(index.spans - 1)))
    keys = asked.select("query_id", "n_clauses", "term", spans.alias("span"))
    keys = keys.withColumn("shard", _shard(index.shards, F.col("span")))
    found = index.blocks().select("shard", "term", "window", "most").join(keys, ["shard", "term"]).where(_span() == F.col("span"))
    return found.groupBy("query_id", "window").agg(F.sum("most").alias("bound"), F.count("*").alias("present"), F.max("n_clauses").alias("n_clauses"))


def _read(index: BlockIndex, asked: DataFrame, chosen: DataFrame, within: DataFrame | None, column: str = "counts") -> DataFrame:
    """query_id, chunk_id, clause and counts (or places) in the blocks of the chosen windows (query_id, window)."""
    wanted = chosen.select("query_id", "window").join(asked.select("query_id", "clause", "term"), "query_id")
    wanted = wanted.withColumn("shard", _shard(index.shards, _span()))
    rows = index.blocks().select("shard", "term", "window", "ids", column).join(wanted, ["shard", "term", "window"])
    rows = rows.select("query_id", "clause", F.explode(F.arrays_zip("ids", column)).alias("c")).select("query_id", "clause", F.col("c.ids").alias("chunk_id"), f"c.{column}")
    if within is None:
        return rows
    on = [c for c in PAIR if c in within.columns]
    return rows.join(within.select(*on).distinct(), on, "left_semi")


def _scores(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*PAIR).agg(F.round(F.sum("counts") * 0.1, 9).alias("score"))


@dataclass(frozen=True)
class Plan:
    """What a search reads: windows by query with their bounds, those for all words, and those of the two rounds."""

    bounds: DataFrame
    every: DataFrame
    first: DataFrame
    rest: DataFrame
    strict: DataFrame
    early: DataFrame


def planned(index: BlockIndex, asked: DataFrame, n: int = TOP, within: DataFrame | None = None) -> Plan:
    """The windows that a search for the n best reads; each round's rows are written once."""
    limits = kept(bounds(index, asked), "bounds")
    every = limits.where("present = n_clauses")
    whole = _read(index, asked, every, within, "places").groupBy(*PAIR).agg(F.count("*").alias("matched"), F.collect_list(F.struct("clause", "places")).alias("parts"))
    n_clauses = asked.groupBy(F.col("query_id").alias("q")).agg(F.max("n_clauses").alias("n_clauses"))
    strict = kept(whole.join(n_clauses, F.col("query_id") == F.col("q")).where("matched = n_clauses").drop("q"), "strict")
    loose = limits.join(strict.select("query_id").distinct(), "query_id", "left_anti")
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "window")
    first = loose.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= FIRST).drop("nth")
    early = kept(_scores(_read(index, asked, first, within)), "early")
    nth = ranked(early, n).where(F.col("rank") == n).select(F.col("query_id").alias("q"), F.col("score").alias("least"))
    rest = loose.join(nth, F.col("query_id") == F.col("q"), "left").drop("q").join(first.select("query_id", "window"), ["query_id", "window"], "left_anti")
    rest = rest.where(F.col("least").isNull() | (F.round(F.col("bound") * 0.1, 9) >= F.col("least")))
    return Plan(limits, every, first, rest, strict, early)


def search(index: BlockIndex, queries: DataFrame, n: int = TOP, within: DataFrame | None = None) -> DataFrame:
    """The ranked lists of retrieval.keyword_search, row for row, from the index.

    Queries with phrases, ``or`` or ``-`` are answered from the postings of their words, without bounds. ``within`` (query_id,
    chunk_id) or (chunk_id) limits the search.
    """
    asked = kept(query_terms(queries, index.stemmed), "asked")
    odd = asked.where("not single").select("query_id").distinct()
    plain = asked.join(odd, "query_id", "left_anti")
    plan = planned(index, plain, n, within)
    at = F.array_sort(F.array_distinct(F.flatten(F.transform("parts", lambda t: F.transform(t["places"], lambda p: F.struct(p.alias("pos"), t["clause"].alias("nth")))))))
    every = plan.strict.withColumn("at", at).select(*PAIR, F.round(cover_density(F.col("at"), F.col("n_clauses")), 9).alias("score"))
    later = _scores(_read(index, plain, plan.rest, within))
    out = ranked(every.unionByName(plan.early).unionByName(later), n)
    if odd.isEmpty():
        return out
    others = queries.join(odd, "query_id", "left_semi")
    return out.unionByName(keyword_search(index.postings(query_terms(others, index.stemmed)), others, n, within, index.stemmed).select(*out.columns))


def reads(index: BlockIndex, queries: DataFrame, n: int = TOP) -> DataFrame:
    """For each query of single words: blocks (of its words in the index) and read (those that a search for the n best opens, each counted once)."""
    asked = kept(query_terms(queries, index.stemmed), "asked")
    plan = planned(index, asked.join(asked.where("not single").select("query_id").distinct(), "query_id", "left_anti"), n)
    opened = plan.every.select("query_id", "window", "present").unionByName(plan.first.select("query_id", "window", "present")).unionByName(plan.rest.select("query_id", "window", "present")).distinct()
    total = plan.bounds.groupBy("query_id").agg(F.sum("present").alias("blocks"))
    return total.join(opened.groupBy("query_id").agg(F.sum("present").alias("read")), "query_id")
