import re

import corpus_pipeline
import pytest
import test_decontaminate
import test_exact_dedup
import test_mixing
import test_ngram_join
from cases import as_tables, frame


def test_each_stage_against_brute_force(spark, tmp_path):
    rows = test_ngram_join.near_corpus(8)
    items = [(0, " ".join(rows[-1][1].split()[:20])), (1, "no such passage here")]
    sf_dir = as_tables(spark, tmp_path, rows, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    docs, left = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = [tuple(r) for r in docs.collect()]
    key = lambda rs: sorted(((r[0], r[1]) for r in rs), key=str)
    lettered = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert key(left["language_id"]) == key(lettered)
    kept = {d for d, best, *_ in test_exact_dedup.brute(lettered) if d == best}
    assert sorted(r[0] for r in left["exact_dedup"]) == sorted(kept)
    groups = {d: c for d, _, c, *_ in test_ngram_join.brute(left["exact_dedup"])}
    assert sorted(r[0] for r in left["ngram_join"]) == sorted({c for c in groups.values()})
    bad = {d for d, *_, c in test_decontaminate.brute(left["ngram_join"], items) if c}
    assert bad and sorted(r[0] for r in left["decontaminate"]) == sorted({r[0] for r in left["ngram_join"]} - bad)
    mixed = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(r[0] for r in left["decontaminate"])
    size = {}
    for r in mixed:
        size[r.source] = size.get(r.source, 0) + r["size"]
    assert {r.source: pytest.approx(r.target) for r in mixed} == test_mixing.expected_targets(size)


def test_stages_on_empty_and_repeated_rows(spark, tmp_path):
    bench = spark.createDataFrame([(0, "a b c")], "item_id long, text string")
    rows = [(1, "one two three four five six seven", "en", "a", 3)] * 3 + [(2, "one two three four five six seven", "en", None, 3)]
    sf_dir = as_tables(spark, tmp_path, rows, benchmark=bench)
    assert [r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()] == [1]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), sf_dir).count() == 0, name
        if name == "ngram_join":
            assert [r.doc_id for r in stage(spark, frame(spark, rows), sf_dir).collect()] == [1]
