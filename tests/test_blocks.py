"""The block index against the search over plain postings, and the running sums that its windows need."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import blocks, ordering, retrieval


def test_running_sums_and_numbers(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, None]), i, r.choice([None, 1, 5, -2])) for i in range(900)]
    df = spark.createDataFrame(rows, "a int, id long, v long").repartition(9)
    want, total = {}, 0
    for n, (_, i, v) in enumerate(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
        total += v or 0
        want[i] = (total, n)
    got = ordering.running(df, ["a", "id"], {"total": "v"}).join(ordering.numbered(df, ["a", "id"]).select("id", "number"), "id").collect()
    assert {x.id: (x.total, x.number) for x in got} == want
    assert ordering.numbered(df.limit(0), ["a", "id"]).collect() == []


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(400)]
    return [(i, None if i % 41 == 7 else " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 3, 20, 20, 200]))), r.choice([None, "context here"])) for i in range(n)]


QUERIES = [(1, "w1 w2 w3"), (2, "w1"), (3, "w40 w41 w42 w43 w44 w45"), (4, "the and"), (5, None), (6, "nowhere"), (7, '"w1 w2" w3'), (8, "w5 or w6 -w7"), (9, "w1 nowhere"), (10, "context w59")]


@pytest.mark.parametrize("size,shards", [(3, 2), (64, 16)])
def test_same_rows_as_plain_postings(spark, monkeypatch, size, shards):
    monkeypatch.setattr(blocks, "SPAN", 5)
    chunks = spark.createDataFrame(corpus(size, 300), "chunk_id long, raw_text string, context_text string").repartition(5)
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    index = blocks.build(chunks, stemmed=True, shards=shards, size=size)
    assert index.spans == (1 if size == 64 else 20)
    for n, within in ((50, None), (5, None), (4, chunks.where("chunk_id % 3 = 0").select("chunk_id")), (4, chunks.where("chunk_id % 5 = 0").select("chunk_id", F.lit(1).cast("long").alias("query_id")))):
        want = retrieval.keyword_search(retrieval.postings(chunks), queries, n, within)
        assert sorted(map(tuple, blocks.search(index, queries, n, within).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    reads = {x.query_id: (x.blocks, x.read) for x in blocks.reads(index, queries, 5).collect()}
    assert all(read <= total for total, read in reads.values()) and {7, 8} & set(reads) == set()
    if size == 3:
        assert reads[3][1] < reads[3][0]


def test_blocks_hold_bounds_and_are_pruned_by_folder(spark):
    chunks = spark.createDataFrame(corpus(2, 200), "chunk_id long, raw_text string, context_text string")
    index = blocks.build(chunks, stemmed=False, size=8)
    rows = index.blocks().collect()
    for b in rows:
        ids = b.ids
        assert ids == sorted(ids) and (b.lo, b.hi, b.n) == (ids[0], ids[-1], len(ids)) and b.most == max(b.counts) and b.counts == [len(x) for x in b.places] and len(ids) <= 8
    assert len({(b.term, b.window) for b in rows}) == len(rows)
    shard = rows[0].shard
    plan = index.blocks().where(F.col("shard") == shard).select("term", "most")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "ReadSchema: struct<term:string,most:int>" in plan


def test_empty_corpus(spark):
    index = blocks.build(spark.createDataFrame([], "chunk_id long, raw_text string"))
    assert blocks.search(index, spark.createDataFrame(QUERIES, "query_id long, query string")).collect() == []


def test_overlap_in_columns(spark):
    rows = spark.createDataFrame([("a B c", "b  x\tA"), ("", "a"), (None, "a"), ("a a", None)], "q string, t string")
    assert [x.s for x in rows.select(retrieval.overlap(F.col("q"), F.col("t")).alias("s")).collect()] == [2 / 3, None, None, 0.0]
