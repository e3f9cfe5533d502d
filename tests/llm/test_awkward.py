"""Every operator over a table whose other columns have the names that it uses itself, with a text of over a megabyte."""

import random

import pytest
from cases import corpus, frame
from pyspark.sql import functions as F
from skein.llm import decontaminate, exact_dedup, language_id, line_dedup, lm_scoring, mixing, ngram_join, quality, substring_dedup, suffix_dedup

NAMES = ("row", "th", "id", "key", "ctx", "band", "spans", "hits", "digest", "size", "target", "copies", "block", "g", "root", "word", "doc_id2", "a.b", "i", "t", "l", "h", "n", "lo", "hi")


def rows():
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    long = " ".join(r.choice(words) + ("\n" if i % 12 == 0 else "") for i in range(190_000))
    assert len(long) > 1 << 20
    some = [x for x in corpus(3, 14) if x[0] is not None]
    return [*some, (900, long, "en", "a", 1), (901, long[5000:9000], "en", "b", 1)]


@pytest.fixture(scope="module")
def frames(spark):
    plain = frame(spark, rows()).cache()
    return plain, plain.withColumns({c: F.lit("x") for c in NAMES})


def bench(spark):
    return spark.createDataFrame([(1, " ".join(rows()[-1][1].split()[10:40]))], "item_id long, text string")


OPERATORS = {
    "suffix_dedup": lambda spark, d: suffix_dedup.dedup_substrings(d, keep="none").select("doc_id", "n_removed"),
    "mixing": lambda spark, d: mixing.mix(d).select("doc_id", "taken"),
    "line_dedup": lambda spark, d: line_dedup.dedup_lines(d).select("doc_id", "n_lines", "n_removed"),
    "ngram_join": lambda spark, d: ngram_join.ngram_join(d).select("doc_id", "class_id", "n_links"),
    "substring_dedup": lambda spark, d: substring_dedup.dedup_words(d).select("doc_id", "n_words", "n_removed"),
    "decontaminate": lambda spark, d: decontaminate.contamination(decontaminate.find_benchmark(d, bench(spark))).select(F.col("row.doc_id").alias("doc_id"), "n_hit"),
    "exact_dedup": lambda spark, d: exact_dedup.exact_dedup(d).select("doc_id", "keep_id", "kept"),
    "language_id": lambda spark, d: language_id.identify(d, language_id.fit(d, per_language=10)).select("doc_id", "lang_pred"),
    "quality": lambda spark, d: quality.score(d, quality.fit(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality")))).select("doc_id", F.round("score", 6).alias("score")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_names_do_not_clash(spark, frames, name):
    plain, odd = (sorted(map(tuple, OPERATORS[name](spark, d).collect()), key=str) for d in frames)
    assert plain == odd and len(plain) == len(rows())
    found = {r[0]: r for r in plain}
    if name in ("suffix_dedup", "substring_dedup"):
        assert found[901][-1] > 400 and (name == "substring_dedup" or found[900][-1] >= 3900)
    if name == "decontaminate":
        assert found[900][1] == 30 and found[901][1] == 30


def test_scores_whole_long_texts(spark, frames):
    got = {r.doc_id: r for r in lm_scoring.lm_score(frames[1], steps=20).collect()}
    assert len(got) >= len({r[0] for r in rows()}) and got[900].n_tokens == len(rows()[-2][1].split()) + 1
