"""Views, chunks, retrieval, evaluation and gates on hand-made rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from skein.functions.vectors import cosine_distance
from skein.operators import chunks as ch
from skein.operators import derive, evals, gates, retrieval
from skein.plans import views as v

DAY = dt.date(2020, 6, 30)


def test_pipeline_status(spark):
    jobs = spark.createDataFrame([(i, f"j{i}") for i in range(1, 8)], "job_id int, job_name string")
    d = dt.date
    acts = spark.createDataFrame(
        [
            (1, "Quote", d(2020, 6, 1)), (1, "Template", d(2020, 6, 1)), (1, "Measure", d(2020, 5, 1)),
            (2, "Quote", d(2020, 1, 1)), (3, "Measure", d(2020, 1, 1)), (3, "Install", d(2020, 7, 5)),
            (4, "Install", d(2020, 2, 1)), (5, "Quote", None), (6, "Quote", d(2020, 7, 1)), (6, "Other", d(2020, 1, 1)),
        ],
        "job_id int, type_name string, activity_date date",
    )
    rows = {r.job_id: r for r in v.pipeline_status(jobs, acts, DAY).collect()}
    assert [rows[i].status for i in range(1, 8)] == ["pending", "quiet", "moved", "not_quoted", "not_quoted", "not_quoted", "not_quoted"]
    assert (rows[1].signal_source, rows[1].days_silent, rows[1].first_signal_date) == ("quote", 29, d(2020, 5, 1))
    assert rows[3].move_is_future and rows[3].days_silent is None
    assert rows[4].moved_forward and not rows[4].is_quoted and rows[4].signal_source is None


def test_crew_workload_counts_jobs_without_areas(spark):
    acts = spark.createDataFrame([(9, 1, "Install", DAY), (9, 1, "Install", DAY), (9, 2, "Install", DAY), (9, 3, "Install", None)], "crew_id int, job_id int, type_name string, activity_date date")
    areas = spark.createDataFrame([(1, 10.0), (1, 20.0)], "job_id int, sq_ft double")
    assert [tuple(r) for r in v.crew_workload(acts, areas, as_of=DAY).collect()] == [(9, 2, 30.0, 30.0)]


def test_cities(spark):
    jobs = spark.createDataFrame([(1, "A", None, None), (2, "B", None, None), (3, "C", "299407", None), (4, "C", "1", "Street"), (5, "D", "29412", "Street"), (6, "D", None, None), (7, " ", "29412", "Street"), (8, " A", None, None)], "job_id int, city string, zip string, address_line1 string")
    names = spark.createDataFrame([("A", "Alpha"), ("B", ""), ("C", derive.NEEDS_ZIP)], "raw_city string, canonical_city string")
    streets = spark.createDataFrame([("Street", "By street")], "address string, assigned_area string")
    rows = derive.normalise_cities(jobs, names, streets, {"29407": "West", "29412": "James"}, {"299407": "29407"})
    assert {r.job_id: (r.city_normalized, r.city_norm_source) for r in rows.collect()} == {
        1: ("Alpha", "name_map"), 2: (None, "excluded"), 3: ("West", "zip"), 4: ("By street", "address_map"), 5: ("By street", "address_map"),
        6: (None, "unresolved"), 7: (None, None), 8: (None, "unresolved"),
    }


LONG = "a note that is surely long enough"


def test_chunks_of_all_sources(spark):
    jobs = spark.createDataFrame([(1, "J", "J", "Town", "S", "P", "Open"), (2, None, "Acc", None, "", None, None)], "job_id int, job_name string, account_name string, city_normalized string, salesperson string, process_name string, job_status_name string")
    acts = spark.createDataFrame([(5, 1, "Quote", "Done", DAY, LONG), (6, 2, None, None, None, LONG + " payment BOT"), (7, 1, "Quote", "Done", DAY, "short")], "activity_id int, job_id int, type_name string, status_name string, activity_date date, notes string")
    areas = spark.createDataFrame([(1, 11, "Kitchen", "K", "72", "Stone", None, LONG), (2, 12, None, "Bath", None, "", None, LONG)], "job_id int, form_id int, area_name string, room_type string, sq_ft_raw string, material_name string, supplier string, notes string")
    forms = spark.createDataFrame([(20, 1, "Job Summary")], "form_id int, job_id int, form_template_name string")
    fields = spark.createDataFrame([(20, "Notes", LONG)], "form_id int, field_name string, field_value string")
    rows = {(r.source_type, r.source_id): r for r in ch.build_chunks(jobs, acts, areas, forms, fields).collect()}
    assert set(rows) == {("activity_note", 5), ("activity_note", 6), ("area_note", 11), ("area_note", 12), ("area_note", 20)}
    one = 'Job "J"; in Town; salesperson S; process P; status Open; materials on this job: Stone'
    assert rows["activity_note", 5].facts == one + "; this note is on a Quote activity; activity status Done; dated 2020-06-30"
    assert rows["activity_note", 6].facts == "Job 2; account Acc; this note is on an activity; undated" and rows["activity_note", 6].is_bot_generated
    assert rows["area_note", 11].facts == one + '; this note is on the "Kitchen" area; room type K; 72 sq ft; area material Stone'
    assert rows["area_note", 12].facts == "Job 2; account Acc; this note is on the job's single area (room type: Bath)"
    assert rows["area_note", 20].facts == one + "; this note is the job's summary-form notes"
    new = ch.build_chunks(jobs, acts, areas, forms, fields)
    old = ch.enrich(new.withColumn("context_text", F.lit(None).cast("string"))).where("source_id != 12").withColumn("text_hash", F.when(F.col("source_id") == 5, F.lit("x")).otherwise(F.col("text_hash")))
    merged = {r.source_id: r.context_text for r in ch.merge_chunks(old, new).collect()}
    assert merged[5] is None and merged[12] is None and merged[11].endswith("Stone.")


def test_stale_and_embed(spark):
    c = spark.createDataFrame([(1, "a", None, "h1"), (2, "b", "ctx", "h2"), (3, "c", None, "h3")], "chunk_id bigint, raw_text string, context_text string, text_hash string")
    have = spark.createDataFrame([(1, "h1"), (2, "old")], "chunk_id bigint, text_hash string")
    todo = ch.stale(c, have)
    made = ch.embed(todo, lambda texts: [[float(len(t))] for t in texts]).collect()
    assert sorted((r.chunk_id, r.embedding, r.text_hash) for r in made) == [(2, [5.0], "h2"), (3, [1.0], "h3")]


def test_patience_and_projected_cost(spark):
    calls, naps = [], []

    def ask(texts):
        calls.append(texts)
        if len(calls) < 4:
            raise ConnectionError("too many")
        return [1]

    assert ch.patient(ask, sleep=naps.append)(["a"]) == [1] and len(calls) == 4
    assert all(0.5 * d <= n <= 1.5 * d for d, n in zip((10, 20, 40), naps))
    calls.clear()
    with pytest.raises(ConnectionError):
        ch.patient(ask, most=0.0, sleep=naps.append)(["a"])
    with pytest.raises(KeyError):
        ch.patient(lambda: {}["x"], sleep=naps.append)()
    c = spark.createDataFrame([("f" * 8, "r" * 4), ("", "")], "facts string, raw_text string")
    assert ch.within_ceiling(c, 0.0, 1.0, 100, 1e3, 1e3) == pytest.approx((110 + 3 + 110 + 160) * 1e3 / 1e6)
    with pytest.raises(ValueError):
        ch.within_ceiling(c, 0.9, 1.0, 100, 1e3, 1e3)


def test_keyword_all_then_any(spark):
    c = spark.createDataFrame([(1, "sinks and the quartz top"), (2, "quartz quartz"), (3, "quartz with one sink far far away"), (4, None), (5, "")], "chunk_id bigint, raw_text string")
    q = spark.createDataFrame([(1, "quartz sink"), (2, "quartz marble"), (3, "the"), (4, "")], "query_id int, query string")
    got = {}
    for r in retrieval.keyword_search(retrieval.postings(c), q).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {1: [1, 3], 2: [2, 1, 3]}
    within = spark.createDataFrame([(3,)], "chunk_id bigint")
    assert [r.chunk_id for r in retrieval.keyword_search(retrieval.postings(c), q, within=within).where("query_id = 1").collect()] == [3]
    words_ = lambda text: [r.chunk_id for r in retrieval.keyword_search(retrieval.postings(c), spark.createDataFrame([(1, text)], "query_id int, query string")).orderBy("rank").collect()]
    assert words_('"one sink"') == [3] and words_("quartz -sink") == [2] and words_('"quartz top" or away') == [1, 3] and words_("marble or quartz") == [2, 1, 3] and words_("-quartz") == []
    find = lambda text: sorted(r.chunk_id for r in retrieval.web_search(c, text).collect())
    assert find('quartz -sink') == [2] and find('"quartz top" or away') == [1, 3] and find("-quartz") == [] and find("") == []


def brute(vectors, query, n):
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    ok = [(i, e) for i, e in vectors if e and len(e) == len(query) and any(e)]
    return [i for i, e in sorted(ok, key=lambda r: (-round(cos(r[1], query), 12), r[0]))][:n]


def test_dense(spark):
    vectors = [(i, [float((i * 7 + k * k) % 11 - 5) for k in range(4)]) for i in range(60)] + [(100, None), (101, [0.0] * 4), (102, [1.0] * 3), (103, [1.0, 2.0, 3.0, 4.0])]
    queries = [(1, [1.0, 2.0, 3.0, 4.0]), (2, [-1.0, 0.5, 0.0, 2.0]), (3, [0.0] * 4)]
    v_, q = spark.createDataFrame(vectors, "chunk_id bigint, embedding array<float>"), spark.createDataFrame(queries, "query_id bigint, embedding array<float>")
    got = {}
    for r in retrieval.dense_search(v_, q, n=5, block=2, slab=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {k: brute(vectors, e, 5) for k, e in queries[:2]}
    far = v_.where("chunk_id in (101, 102, 103)").select("chunk_id", cosine_distance(F.col("embedding"), F.array(*[F.lit(x) for x in queries[0][1]])).alias("d"))
    assert {r.chunk_id: r.d if r.d is None else round(r.d, 9) for r in far.collect()} == {101: None, 102: None, 103: 0.0}


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, chunk_id bigint, rank int")


def test_fuse_and_rerank(spark):
    fused = retrieval.fuse(lists(spark, [(1, 10, 1), (1, 11, 2)]), lists(spark, [(1, 11, 1), (1, 12, 2)]))
    rows = [(r.chunk_id, r.keyword_rank, r.dense_rank, r.rank) for r in fused.orderBy("rank").collect()]
    assert rows == [(11, 2, 1, 1), (10, 1, None, 2), (12, None, 2, 3)]
    q = spark.createDataFrame([(1, "red edge")], "query_id bigint, query string")
    c = spark.createDataFrame([(10, "blue"), (12, "red edge"), (11, "the red")], "chunk_id bigint, raw_text string")
    order = lambda df: [r.chunk_id for r in df.orderBy("rank").collect()]
    assert order(retrieval.rerank(fused, q, c)) == [12, 11, 10]
    assert order(retrieval.rerank(fused, q, c, n=2, scorer=None)) == [11, 10]
    jobs = c.withColumn("job_id", F.col("chunk_id") % 2)
    assert retrieval.narrowed(jobs, spark.createDataFrame([(1,)], "job_id bigint")).count() == 1
    assert retrieval.narrowed(jobs, spark.createDataFrame([], "job_id bigint")).count() == 3
    assert retrieval.narrowed(jobs, spark.createDataFrame([], "job_id bigint"), open_if_empty=False).count() == 0
    assert retrieval.narrowed(jobs, spark.range(1)).count() == 3


def test_ranking_metrics(spark):
    ranks = lists(spark, [(1, c, r) for r, c in enumerate([5, 6, 7], 1)] + [(2, 9, 1)]).withColumn("lane", F.lit("x"))
    gold = spark.createDataFrame([(1, 6), (1, 7), (1, 99)], "query_id bigint, chunk_id bigint")
    rows = {r.query_id: r for r in evals.ranking_metrics(ranks, gold).collect()}
    ideal = sum(1 / math.log2(i + 1) for i in (1, 2, 3))
    assert rows[1].recall_at_5 == pytest.approx(2 / 3) and rows[1].mrr == 0.5
    assert rows[1].ndcg == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / ideal)
    assert rows[2].recall_at_5 is None and rows[2].ndcg is None and rows[2].mrr == 0.0
    (m,) = evals.means(evals.ranking_metrics(ranks, gold)).collect()
    more = spark.createDataFrame([(1, 6), (1, 7), (1, 99), (3, 4)], "query_id bigint, chunk_id bigint")
    missed = {r.query_id: r for r in evals.ranking_metrics(ranks, more).collect()}
    assert set(missed) == {1, 2, 3} and (missed[3].recall_at_5, missed[3].mrr, missed[3].ndcg) == (0.0, 0.0, 0.0)
    assert m.n == 2 and m.mrr == 0.25 and m.recall_at_10 == pytest.approx(2 / 3, abs=1e-6)


def test_scores(spark):
    pairs = spark.createDataFrame([("structured", "structured"), ("semantic", "junk"), ("semantic", "semantic")], "expected string, predicted string")
    rows = {r.expected: r for r in evals.confusion_matrix(pairs).collect()}
    assert rows["semantic"].as_refuse == 1 and rows["hybrid"].as_semantic == 0 and len(rows) == 4
    cases = [("refuse", "refuse", None, "x", None, True), ("structured", "semantic", "5", "it is 5", None, True), ("structured", "x", "many", "some", True, True), ("semantic", "x", "5", "5", False, False)]
    df = spark.createDataFrame(cases, "er string, pr string, e string, a string, j boolean, want boolean")
    got = df.withColumn("got", evals.correct(*[F.col(c) for c in ("er", "pr", "e", "a", "j")])).collect()
    assert [r.got for r in got] == [r.want for r in got]
    runs = spark.createDataFrame([("m", True, 1.0, 0.5), ("m", False, 3.0, 0.5), ("n", False, 1.0, 0.1)], "model string, correct boolean, seconds double, cost double")
    assert {r.model: (r.n_correct, r.mean_seconds, r.cost_per_correct) for r in evals.cost_summary(runs).collect()} == {"m": (1, 2.0, 1.0), "n": (0, 1.0, None)}
    now, base = spark.createDataFrame([("a", 0.5), ("b", 0.96)], "metric string, value double"), spark.createDataFrame([("a", 0.6), ("b", 1.0), ("c", 0.1)], "metric string, value double")
    assert {r.metric for r in evals.regressions(now, base).collect()} == {"a", "c"}
    report = evals.failure_report(spark.createDataFrame([(1, "verified", False), (2, "FAILING", True), (3, "draft", False)], "id int, status string, correct boolean"))
    assert {r.id: r.report for r in report.collect()} == {1: "new failure", 2: "now passes"}
    gold = evals.read_golden(spark.createDataFrame([(1, "draft", "1, 2"), (2, "retired", "3"), (3, "verified", None)], "id int, status string, relevant_ids string"))
    assert {r.id: r.relevant_ids for r in gold.collect()} == {1: [1, 2], 3: []}
    p = spark.range(1).select(evals.context_precision(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))), evals.context_precision(F.array(F.lit(1)), F.array().cast("array<int>"))).first()
    assert tuple(p) == (0.5, None)


def test_gates(spark):
    child, parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int")
    ok = lambda df: [r.ok for r in df.collect()]
    assert ok(gates.no_orphans(child, parent, "k", "g")) == [False] and ok(gates.no_orphans(child, parent, "k", "g", 0.25)) == [True]
    assert ok(gates.row_count(child, "n", 4)) == [True] and ok(gates.row_count(child, "n", 9, 4)) == [False]
    assert ok(gates.unique_key(child, ["k"], "u")) == [False] and ok(gates.unique_key(parent, ["k"], "u")) == [True]
    cities = spark.createDataFrame([("a",)] * 3 + [("b",)] * 9, "city string")
    want = spark.createDataFrame([("a", 5), ("b", 5)], "city string, n int")
    assert {r.gate: r.ok for r in gates.group_counts(cities, "city", want).collect()} == {"city a": True, "city b": False, "city total": True}
    notes = spark.createDataFrame([("x cost_usd=1.5",), ("cost_usd=2",), (None,)], "note string")
    assert ok(gates.spend(notes, 3.5)) == [True] and ok(gates.spend(notes, 3.0)) == [False]
    assert gates.failed(gates.row_count(child, "n", 9)).count() == 1
    assert ok(gates.coverage(F.col("k") > 0, child, "c")) == [False]


def test_chunks_of_three_sources_meet_the_facts_once(spark):
    """One join to the facts of jobs for notes of all sources, so that facts are computed once."""
    areas = spark.createDataFrame([(1, 5, "", "Bath", None, "oak", None, "a note of more than twenty-five letters"), (2, 6, "", "Bath", None, "oak", None, "a note of more than twenty-five letters")], "job_id long, form_id long, area_name string, room_type string, sq_ft_raw string, material_name string, supplier string, notes string")
    acts = spark.createDataFrame([(1, 10, None, "Done", None, "a note of more than twenty-five letters")], "job_id long, activity_id long, type_name string, status_name string, activity_date date, notes string")
    forms, fields = spark.createDataFrame([(8, 2, "Job Summary")], "form_id long, job_id long, form_template_name string"), spark.createDataFrame([(8, "Notes", "a note of more than twenty-five letters")], "form_id long, field_name string, field_value string")
    facts = spark.createDataFrame([(1, "Job 1", 1), (2, "Job 2", 2)], "job_id long, job_facts string, n_areas long")
    out = ch.with_facts(ch.notes_of(acts, areas, forms, fields), facts)
    assert {r.source_id: r.facts for r in out.collect()} == {
        5: "Job 1; this note is on the job's single area (room type: Bath); area material oak", 6: "Job 2; this note is on one of the job's areas; area material oak",
        8: "Job 2; this note is the job's summary-form notes", 10: "Job 1; this note is on an activity; activity status Done; undated",
    }
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("job_facts") and sum(line.lstrip(" :+-").startswith("Join") for line in plan.splitlines()) == 2
