"""The guarded SQL lane: what it lets through, what it turns away, limits, repair and the answers built on it."""

import time

import pytest
from pyspark.sql import functions as F

from skein.operators import retrieval
from skein.plans import answer as an
from skein.plans import loads
from skein.plans.guard import Guard, Rejected, run_structured, unfenced


def views(session):
    return {"v_jobs": session.range(500).select(F.col("id").alias("job_id"), F.when(F.col("id") % 2 == 0, "Ann").otherwise("Bob").alias("salesperson")), "v_other": session.range(3)}


@pytest.fixture(scope="module")
def guard(spark):
    spark.range(2).createOrReplaceTempView("hidden")
    return Guard(spark, views, timeout=120)


GOOD = [
    "SELECT salesperson, count(*) AS n FROM v_jobs GROUP BY salesperson HAVING count(*) > 1 ORDER BY n DESC LIMIT 5",
    "WITH a AS (SELECT job_id FROM v_jobs WHERE job_id < 5) SELECT DISTINCT job_id FROM a",
    "SELECT j.job_id FROM v_jobs j JOIN v_other o ON o.id = j.job_id WHERE j.job_id IN (SELECT id FROM v_other)",
    "```sql\nSELECT max(job_id) FROM v_jobs;\n```",
    "SELECT job_id, (SELECT max(id) FROM v_other) AS m FROM v_jobs WHERE salesperson ILIKE '%an%'",
]
BAD = [
    "", "SELECT 1 FROM v_jobs; SELECT 2 FROM v_jobs", "DROP TABLE v_jobs", "INSERT INTO v_jobs VALUES (1, 'x')", "CREATE VIEW x AS SELECT 1", "SET spark.sql.ansi.enabled=false",
    "SELECT job_id FROM v_jobs UNION SELECT id FROM v_other", "SELECT job_id FROM v_jobs UNION ALL SELECT id FROM v_other ORDER BY 1 LIMIT 3", "TABLE v_jobs", "VALUES (1)", "FROM v_jobs |> WHERE job_id = 1",
    "SELECT * FROM hidden", "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`", "SELECT nothing FROM v_jobs", "SELECT * FROM range(5)", "SELECT reflect('java.lang.System', 'getenv') FROM v_jobs",
    "SELECT java_method('java.util.UUID', 'randomUUID') FROM v_jobs", "WITH v_jobs AS (SELECT 1 AS job_id) SELECT * FROM v_jobs", "SELECT job_id FROM v_jobs WHERE job_id = (SELECT max(id) FROM hidden)",
    "SELECT job_id FROM v_jobs WHERE EXISTS (SELECT 1 FROM range(3))", "SELECT job_id FROM v_jobs WHERE job_id IN (SELECT length(version()) FROM v_other)", "EXPLAIN SELECT 1 FROM v_jobs", "SELECT explode(array(1)) FROM v_jobs",
    "WITH a AS (SELECT * FROM hidden) SELECT * FROM a", "SELECT * FROM v_jobs LATERAL VIEW explode(array(1)) t AS x",
]


@pytest.mark.parametrize("sql", GOOD)
def test_allowed(guard, sql):
    assert guard.run(sql).rows


@pytest.mark.parametrize("sql", BAD)
def test_rejected(guard, sql):
    with pytest.raises(Rejected):
        guard.run(sql)


def test_limits(guard):
    r = guard.run("SELECT * FROM v_jobs")
    assert len(r.rows) == 200 and r.row_count == 500
    r = guard.run("SELECT * FROM v_jobs LIMIT 450")
    assert len(r.rows) == 450 and r.row_count == 500
    r = guard.run("SELECT * FROM v_jobs LIMIT 3")
    assert len(r.rows) == 3 and r.row_count == 500
    r = guard.run("SELECT job_id FROM v_jobs WHERE job_id IN (SELECT job_id FROM v_jobs ORDER BY 1 LIMIT 3)")
    assert len(r.rows) == 3 and r.row_count == 3
    assert guard.run("SELECT * FROM v_jobs WHERE job_id < 0 LIMIT 3").row_count == 0
    assert unfenced("```\nSELECT 1;\n```") == "SELECT 1"


@pytest.mark.parametrize("seconds", [0.5, 3])
def test_timeout(spark, seconds):
    slow = Guard(spark, lambda s: {"v": s.range(10**8).select(F.sha2(F.sha2(F.col("id").cast("string"), 512), 512).alias("h"))}, timeout=seconds)
    start = time.monotonic()
    with pytest.raises(TimeoutError):
        slow.run("SELECT max(h) FROM v")
    assert time.monotonic() - start < seconds + 30
    tracker = spark.sparkContext.statusTracker()
    assert not tracker.getActiveJobsIds()


def test_repair(guard):
    asked = []

    def generate(question, bad, error):
        asked.append((bad, error and error[:7]))
        return "SELECT oops FROM v_jobs" if bad is None else "SELECT count(*) AS n FROM v_jobs"

    assert run_structured(guard, "q", generate).rows[0].n == 500
    assert asked[0] == (None, None) and asked[1][0] == "SELECT oops FROM v_jobs"
    with pytest.raises(Rejected):
        run_structured(guard, "q", lambda *a: "DROP TABLE x")


def test_routes():
    assert [an.rule_router(q).route for q in ("How many jobs?", "What did the notes mention?", "How many notes mention a problem?", " ")] == ["structured", "semantic", "hybrid", "refuse"]

    def broken(q):
        raise ValueError("no JSON")

    assert an.route("x", broken).route == "semantic"
    assert an.route("x", lambda q: an.Route("nonsense", "")).route == "semantic"


def test_engine(spark, guard):
    rows = [(1, 2, "the sink was late", "ctx", False, [1.0, 0.0]), (2, 3, "payment bot wrote this", "", True, [0.0, 1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, job_id bigint, raw_text string, context_text string, is_bot_generated boolean, embedding array<float>")
    engine = an.Engine(spark, chunks.drop("embedding"), retrieval.postings(chunks), chunks.select("chunk_id", "embedding"), lambda q: [1.0, 0.1], guard, lambda q, b, e: "SELECT job_id FROM v_jobs WHERE job_id = 3")
    assert engine.answer("?").text == an.REFUSAL
    a = engine.answer("why was the sink late")
    assert a.chunk_ids[0] == 1 and "[1] ctx" in a.text and "[2] [automated]" in a.text
    assert engine.answer("how many jobs").text == "job_id\n3"
    assert engine.answer("how many notes mention the sink").chunk_ids == [2]
    engine.generate = lambda *x: "DROP TABLE v"
    assert engine.answer("how many jobs").chunk_ids


def test_statements_of_one_shape_are_parsed_once(spark, guard, monkeypatch):
    """Verdicts of many statements equal those one by one, and statements that differ in numbers alone are one."""
    alike = ["SELECT count(*) FROM v_jobs WHERE job_id > {}", "DROP TABLE v_jobs_{}", "SELECT 1; SELECT {}", "SELECT * FROM parquet.`/data/{}`", "SELECT java_method('java.lang.System', 'exit', {})", "SELECT no_such_{} FROM v_jobs", "WITH w_{} AS (SELECT {} AS a) SELECT a FROM w_{}"]
    apart = [
        "SELECT job_id FROM v_jobs ORDER BY {}", "SELECT job_id, count(*) FROM v_jobs GROUP BY {}", "SELECT job_id FROM v_jobs LIMIT {}", "SELECT CAST(job_id AS decimal({}, 2)) FROM v_jobs", "SELECT percentile(job_id, {}) FROM v_jobs",
        "SELECT `{}` FROM (SELECT 5)", "SELECT `{}` FROM (SELECT 05)", "SELECT `{}` FROM (SELECT '5')", "WITH a_{} AS (SELECT 1 AS k) SELECT * FROM a_5", "SELECT * FROM VALUES (999999999 + 999999999 + {}99999999)", "SELECT ntile({}) OVER (ORDER BY job_id) FROM v_jobs",
        "SELECT DATE '2000-01-{}' FROM v_jobs", "SELECT {}{}{}Y FROM v_jobs", "SELECT job_id FROM v_jobs WHERE job_id > -{}", "SELECT job_id /* {} */ FROM v_jobs", "SELECT {} > 5 AS a FROM v_jobs WHERE salesperson = 'it''s'", "",
    ]
    rows = [(i, p.format(*[n] * 3)) for i, (p, n) in enumerate((p, n) for p in alike + apart for n in (0, 1, 2, 3, 5, 35, 77))] + [(999, None)]
    want = {i: guard.verdict(sql or "") for i, sql in rows}
    asked, verdict = [], Guard.verdict
    monkeypatch.setattr(Guard, "verdict", lambda self, sql: asked.append(sql) or verdict(self, sql))
    got = {r.k: r.verdict for r in guard.verdicts(spark.createDataFrame(rows, "k long, sql string")).collect()}
    assert got == want
    asked.clear()
    many = spark.range(20, 3000).select("id", F.replace(F.element_at(F.array(*map(F.lit, alike)), (F.col("id") % len(alike) + 1).cast("int")), F.lit("{}"), F.col("id").cast("string")).alias("sql"))
    assert guard.verdicts(many).count() == 2980 and len(asked) == len(alike)


def test_written_views_have_the_columns_that_questions_name(spark):
    df = spark.range(1).selectExpr("id AS job_id", "id AS city", "id AS note")
    assert loads._named(df, "SELECT CITY, count(*) FROM v GROUP BY city; SELECT job_id FROM v").columns == ["job_id", "city"]
    assert loads._named(df, "SELECT * FROM v WHERE city = 1").columns == loads._named(df, "SELECT count(*) FROM v").columns == df.columns
