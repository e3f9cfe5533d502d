"""The keyword lane by slabs against the search over plain postings, and questions as plain words."""

import random

import pytest
from pyspark.sql import functions as F

import oracle
from skein.operators import retrieval, slabs
from skein.plans.catalog import QUERIES, SQL

QUESTIONS = [(1, "w1 w2 w3"), (2, "w1"), (3, "w40 w41 w42 w43 w44 w45"), (4, "the and"), (5, None), (6, "nowhere"), (7, '"w1 w2" w3'), (8, "w5 or w6 -w7"), (9, "w1 nowhere"), (10, "context w59"), (11, '"the w1 w2" -"w3 w4"'), (12, "w1-w2 w1"), (13, "-w1")]


def corpus(spark, seed, n=300):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(400)] + ["the", "-", "Running"]
    rows = [(i, None if i % 41 == 7 else " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 3, 20, 20, 200]))), r.choice([None, "context runs here"])) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, raw_text string, context_text string").repartition(3)


@pytest.mark.parametrize("seed,stemmed,n,block,slab,hits", [(1, True, 50, 100, 1000, 1 << 20), (2, False, 4, 3, 40, 50)])
def test_same_rows_as_plain_postings(spark, monkeypatch, seed, stemmed, n, block, slab, hits):
    monkeypatch.setattr(slabs, "HITS", hits)
    chunks, queries = corpus(spark, seed), spark.createDataFrame(QUESTIONS, "query_id long, query string")
    index = retrieval.postings(chunks, stemmed)
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    want = rows(retrieval.keyword_search(index, queries, n, stemmed=stemmed))
    assert rows(slabs.search(chunks, queries, n, stemmed, block, slab)) == want and len(want) > 20
    whole = retrieval.matches(index, queries, stemmed=stemmed).where("matched = n_clauses").groupBy("query_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("m"))
    assert sorted(map(tuple, slabs.counted(chunks, queries, stemmed, block, slab).select("query_id", "chunks", "first_chunk").collect())) == sorted(map(tuple, whole.collect()))
    assert slabs.search(chunks.limit(0), queries).collect() == slabs.search(chunks, queries.limit(0)).collect() == []


#: Questions whose punctuation and ``or`` would be syntax in a web search; texts that hold all their words, and some.
PLAIN = ["alpha beta or gamma-delta", 'alpha -beta "gamma delta"', "beta OR delta", "epsilon's alpha", "or and", ""]
TEXTS = ["alpha beta gamma delta", "delta gamma alpha", "beta", "gamma delta delta", "alpha s epsilon or", "", None, "alpha; beta, delta"]


@pytest.mark.parametrize("name", ["evidence_of_questions", "keyword_blocks_read", "keyword_matches", "keyword_top50", "ordered_lookup", "rerank_top6"])
def test_questions_are_plain_words(spark, tmp_path, name):
    write = lambda rows, kind, table: spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    write([(i, t, "en", f"source{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write(list(enumerate(PLAIN)), "item_id long, text string", "benchmark")
    write([(i, [float(i + 1), 1.0], i % 2) for i in range(len(TEXTS))], "vec_id long, embedding array<float>, label int", "embeddings")
    assert oracle.differences(QUERIES[name](spark, str(tmp_path)), oracle.connect(str(tmp_path)), SQL[name]) == []


def test_rare_words_first_and_any_word_once(spark, monkeypatch):
    """Only queries without a chunk that has all their words are asked for any of them, and then in one more pass; a pass is not made for none."""
    asked, tasks = [], slabs._tasks

    def counted_tasks(chunks, queries, step, *rest):
        asked.append(sorted(r.query_id for r in queries.collect()))
        return tasks(chunks, queries, step, *rest)

    monkeypatch.setattr(slabs, "_tasks", counted_tasks)
    chunks = spark.createDataFrame([(1, "red green blue"), (2, "red red"), (3, "Blue-green"), (4, None)], "chunk_id long, raw_text string")
    make = lambda *rows: spark.createDataFrame(list(rows), "query_id long, query string")
    rows = lambda q: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in slabs.search(chunks, q, stemmed=False, slab=2).collect())
    assert rows(make((1, "green blue"), (2, "red yellow"), (3, "the"), (4, None))) == [(1, 1, 1, 0.1), (1, 2, 3, 0.1), (2, 1, 2, 0.2), (2, 2, 1, 0.1)]
    assert asked == [[1, 2], [2]]
    asked.clear()
    assert rows(make((1, "green blue"), (5, "red"))) == [(1, 1, 1, 0.1), (1, 2, 3, 0.1), (5, 1, 2, 0.2), (5, 2, 1, 0.1)]
    assert asked == [[1, 5]]


def test_words_joined_and_overlap_in_arrow(spark):
    from skein.functions.text import words, words_joined

    texts = ["", None, "  ", "Élan vital—2nd\tTRY\x0bx\x0cy\r\nz", "a b a c İstanbul", "x-y  z", "١٢ กำ q_r"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, raw_text string")
    assert [r.a for r in rows.select(words_joined(F.col("raw_text")).alias("a")).collect()] == [r.a for r in rows.select(F.array_join(words(F.col("raw_text")), " ").alias("a")).collect()]
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["X Y z élan", None, "a İstanbul b a b", "q_r ١٢"])], "query_id long, query string")
    pairs = queries.crossJoin(rows)
    want = sorted((r.query_id, r.chunk_id, r.s) for r in pairs.select("query_id", "chunk_id", F.coalesce(retrieval.overlap(F.col("query"), F.col("raw_text")), F.lit(0.0)).alias("s")).collect())
    got = retrieval.rerank(pairs.select("query_id", "chunk_id", F.lit(1).alias("rank")), queries, rows, 50)
    assert sorted((r.query_id, r.chunk_id, r.score) for r in got.collect()) == want and any(0 < s for *_, s in want)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
