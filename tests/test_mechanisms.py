"""Clusters, samples, request batches, the report sink, incremental status and streaming state against plain versions."""

import datetime as dt
import decimal
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from skein.operators import chunks as ch
from skein.operators import clusters, evals, retrieval
from skein.plans import incremental, views
from skein.sources import report, sinks
from skein.streaming import signals


def vectors(seed, n):
    """Around few directions, with ties, zeros, nulls and another length."""
    r = np.random.default_rng(seed)
    middle = r.normal(size=(6, 16))
    rows = [(i, [float(x) for x in middle[i % 6] + 0.05 * r.normal(size=16)]) for i in range(n)]
    rows[5:9] = [(i, rows[11][1]) for i in range(5, 9)]
    return [*rows, (n, None), (n + 1, [0.0] * 16), (n + 2, [1.0, 2.0]), (n + 3, [2.0, 1.0]), (n + 4, [])]


@pytest.mark.parametrize("most,slab", [(1, 1000), (12, 20)])
def test_clusters_give_the_same_lists(spark, monkeypatch, most, slab):
    monkeypatch.setattr(clusters, "BLOCK", 3)
    table = spark.createDataFrame(vectors(1, 400), "chunk_id long, embedding array<float>").repartition(4)
    queries = table.where("chunk_id % 25 = 0 or chunk_id > 398").select(F.col("chunk_id").alias("query_id"), "embedding")
    index = clusters.build(table, most=most, slab=slab)
    assert index.vectors().count() == 402
    for n, within in ((50, None), (3, None), (5, table.where("chunk_id % 3 = 0").select("chunk_id"))):
        want = retrieval.dense_search(table, queries, n, within)
        assert sorted(map(tuple, clusters.search(index, queries, n, within).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    if most == 12:
        reads = {r.query_id: (r.clusters, r.read) for r in clusters.reads(index, queries, 10).collect()}
        assert all(r <= c for c, r in reads.values()) and sum(r for _, r in reads.values()) < 0.7 * sum(c for c, _ in reads.values())


def test_clusters_of_lengths_that_the_sample_lacks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "PER_CENTER", 1)
    table = spark.createDataFrame([*vectors(2, 60)[:60], *[(100 + i, [float(i), 1.0, 2.0]) for i in range(3)]], "chunk_id long, embedding array<float>")
    queries = table.select(F.col("chunk_id").alias("query_id"), "embedding").where("chunk_id in (3, 101)")
    want = retrieval.dense_search(table, queries, 5).collect()
    assert sorted(map(tuple, clusters.search(clusters.build(table, most=2), queries, 5).collect())) == sorted(map(tuple, want))
    empty = clusters.build(table.limit(0))
    assert clusters.search(empty, queries, 5).collect() == []


def test_dense_within_pairs(spark):
    table = spark.createDataFrame(vectors(3, 60), "chunk_id long, embedding array<float>")
    queries = table.where("chunk_id in (3, 10, 62)").select(F.col("chunk_id").alias("query_id"), "embedding")
    pairs = table.where("chunk_id % 2 = 0").select(F.lit(3).cast("long").alias("query_id"), "chunk_id")
    want = retrieval.dense_search(table, queries.where("query_id = 3"), 7, pairs.select("chunk_id")).collect()
    assert sorted(map(tuple, retrieval.dense_within(table, queries, pairs, 7).collect())) == sorted(map(tuple, want))


def test_samples_do_not_depend_on_partitions_and_merge(spark):
    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "id long, w double")
    for weight in (None, "w"):
        of = lambda df: [r.id for r in evals.sample(df, 20, 5, ["id"], weight).collect()]  # noqa: B023, E731
        want = of(rows)
        assert of(rows.repartition(7)) == of(rows.coalesce(1)) == want and len(want) == 20 and want != [r.id for r in evals.sample(rows, 20, 6, ["id"], weight).collect()]
        parts = [evals.sample(rows.where(F.col("id") % 3 == i), 20, 5, ["id"], weight) for i in range(3)]
        assert [r.id for r in evals.merged(parts, 20, 5, ["id"], weight).collect()] == want
    assert evals.sample(rows.where("w = 0"), 5, 1, ["id"], "w").collect() == []
    picks = [r.w for s in range(40) for r in evals.sample(rows, 10, s, ["id"], "w").collect()]
    assert 4.0 < sum(picks) / len(picks) < 4.7  # the mean weight of picks is the sum of squares over the sum: 4.33


def test_request_batches_stop_at_the_ceiling(spark):
    r = random.Random(4)
    rows = [("note", i, "f" * r.randint(0, 9), "t" * r.randint(0, 4000)) for i in range(450)]
    df = spark.createDataFrame(rows, "source_type string, source_id long, facts string, raw_text string").repartition(7)
    want, total = [], decimal.Decimal("0.01")
    for n, (_, i, f, t) in enumerate(sorted(rows)):
        cost = (decimal.Decimal(110 + (len(f) + len(t)) // 4) * decimal.Decimal("1.25") + 80 * decimal.Decimal("5.5")) / 10**6
        total += cost
        if total <= decimal.Decimal("0.3"):
            want.append((i, n, n // 20, cost, total))
    got = ch.request_batches(df, 100, 1.25, 5.5, ceiling=0.3, spent=0.01, most=20).collect()
    assert sorted((x.source_id, x.request, x.batch, x.cost, x.running) for x in got) == want and 0 < len(want) < 450
    assert ch.request_batches(df, 100, 1.25, 5.5).count() == 450 and ch.request_batches(df.limit(0), 1, 1, 1).collect() == []


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5, dt.date(2020, 1, 1)), ("a", 2, None, None), ("b", 3, math.nan, None), ("b", 4, 1.0, None), ("ü|", 5, 2.25, None)], "lane string, n int, score double, day date").repartition(3)
    path = f"{tmp_path}/r"
    report.write_report(rows, path, "lane", metrics="score", title="Title", notes="as of then")
    assert sorted(r.line for r in report.read_lines(spark, path).collect()) == ["| a | 2 | 0.500 |", "| b | 2 | 1.000 |", "| ü| | 1 | 2.250 |"]
    text = open(f"{path}/report.md", encoding="utf-8").read()
    assert text.startswith("# Title\n\nas of then\n\n| lane | rows | score |\n|---|---|---|\n")
    detail = report.read_detail(spark, path, "lane string, n int, score double, day date").collect()
    assert sorted(r.n for r in detail) == [1, 2, 3, 4, 5] and {r.day for r in detail} == {dt.date(2020, 1, 1), None}
    summary = json.load(open(f"{path}/summary.json", encoding="utf-8"))
    assert summary["rows"] == {"a": 2, "b": 2, "ü|": 1} and len(summary["files"]) == len(os.listdir(f"{path}/detail"))
    report.write_report(rows.limit(0), f"{tmp_path}/empty", "lane")
    assert report.read_detail(spark, f"{tmp_path}/empty", "lane string").collect() == []


def test_a_report_that_fails_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).repartition(4).select(F.lit("a").alias("lane"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("double")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        report.write_report(rows, f"{tmp_path}/r", "lane")
    left = [f for _, _, names in os.walk(f"{tmp_path}/r") for f in names]
    assert "summary.json" not in left and "report.md" not in left and not [f for f in left if f.endswith(".json")]
    with pytest.raises(Exception, match="no columns"):
        report.write_report(spark.range(3).withColumn("lane", F.lit("a")), f"{tmp_path}/q", "lane", metrics="nowhere")


def test_a_task_that_is_killed_leaves_nothing(spark, tmp_path):
    """A task has nothing in the report before it has all its rows, and abort deletes the files of tasks that sent no message."""
    from pyspark.sql.types import StructType

    schema = StructType().add("lane", "string").add("x", "double")
    writer = report.ReportWriter(schema, {"path": f"{tmp_path}/r", "label": "lane"})

    def killed():
        yield Row(lane="a", x=1.0)
        assert not os.path.exists(f"{tmp_path}/r/detail") or not os.listdir(f"{tmp_path}/r/detail")
        raise SystemExit

    with pytest.MonkeyPatch.context() as m:
        m.setattr(report.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda s: 0, "taskAttemptId": lambda s: 7})()))
        with pytest.raises(SystemExit):
            writer.write(killed())
        part = writer.write(iter([Row(lane="a", x=1.0)]))
        assert os.listdir(f"{tmp_path}/r/detail") == [os.path.basename(part.file)]
        open(f"{tmp_path}/r/detail/of-another-job.json", "w").close()
        writer.abort([None, None])
        with pytest.raises(RuntimeError, match="ended"):
            writer.write(iter([Row(lane="a", x=1.0)]))
    assert os.listdir(f"{tmp_path}/r/detail") == ["of-another-job.json"]


def test_a_task_that_outlives_its_job_never_shows_a_file(tmp_path):
    """A job that ends while a task copies its rows: no detail file is there at any time, and none is left."""
    from pyspark.sql.types import StructType

    writer = report.ReportWriter(StructType().add("lane", "string").add("x", "double"), {"path": f"{tmp_path}/r", "label": "lane"})
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(report.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda s: 0, "taskAttemptId": lambda s: 7})()))
        copy = report.shutil.copyfileobj

        def slow(*args):
            copy(*args)
            m.setattr(report.ReportWriter, "_ended", lambda *a: True)
            seen.extend(os.listdir(f"{tmp_path}/r/detail"))

        m.setattr(report.shutil, "copyfileobj", slow)
        with pytest.raises(RuntimeError, match="ended"):
            writer.write(iter([Row(lane="a", x=1.0)]))
    assert seen and not [f for f in seen if f.endswith(".json")]
    assert os.listdir(f"{tmp_path}/r/detail") == []


KINDS = ["Quote", "Measure", "Template", "Install", "Removal", "Invoice"]


def activities(seed, n):
    r = random.Random(seed)
    day = lambda: None if r.random() < 0.2 else dt.date(2000, 6, 1) + dt.timedelta(r.randint(0, 300))
    return {j * 1000 + i: (j * 1000 + i, j, r.choice(KINDS), day()) for j in range(n) for i in range(r.randint(0, 6))}


ACTIVITY = "activity_id long, job_id long, type_name string, activity_date date"


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_deltas_equal_a_full_build(spark, tmp_path):
    r = random.Random(9)
    store = incremental.StatusStore(sinks.Layer(spark, f"{tmp_path}/layer"), buckets=4)
    now, jobs = activities(1, 30), {j: f"job {j}" for j in range(30)}
    frame = lambda rows: spark.createDataFrame(list(rows), ACTIVITY)
    named = lambda some: spark.createDataFrame(list(some.items()), "job_id long, job_name string")
    store.apply(named(jobs), frame(now.values()))
    for step in range(3):
        new = {k: v for k, v in activities(step + 20, 33).items() if r.random() < 0.1}
        gone = r.sample(sorted(now), 5)
        more = {30 + step: f"new {step}", step: f"renamed {step}"}
        delta = frame(new.values()).withColumn("deleted", F.lit(False)).unionByName(frame(now[k] for k in gone if k not in new).withColumn("deleted", F.lit(True)))
        now = {k: v for k, v in (now | new).items() if k not in gone or k in new}
        jobs |= more
        store.apply(named(more), delta)
        want = as_rows(views.pipeline_status(named(jobs), frame(now.values())))
        assert as_rows(store.status()) == want and store.deltas() == step + 2
    store.compact()
    assert sorted(x for x in os.listdir(f"{tmp_path}/layer/activity_log") if x.startswith("delta")) == ["delta=4"]
    store.apply(named({0: "again"}), frame([]))
    assert as_rows(store.status()) == as_rows(views.pipeline_status(named(jobs | {0: "again"}), frame(now.values())))


def test_a_failed_delta_is_not_seen(spark, tmp_path, monkeypatch):
    store = incremental.StatusStore(sinks.Layer(spark, f"{tmp_path}/layer"), buckets=2)
    jobs = spark.createDataFrame([(1, "a"), (2, "b")], "job_id long, job_name string")
    frame = lambda rows: spark.createDataFrame(rows, ACTIVITY)
    store.apply(jobs, frame([(1, 1, "Quote", dt.date(2000, 12, 20))]))
    before = as_rows(store.status())
    with monkeypatch.context() as m:
        m.setattr(incremental, "pipeline_status", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.apply(jobs.limit(0), frame([(2, 2, "Quote", dt.date(2000, 12, 1))]))
    assert as_rows(store.status()) == before and store.deltas() == 1
    store.apply(jobs.limit(0), frame([(3, 1, "Install", dt.date(2000, 12, 30))]))
    assert {r.job_id: r.status for r in store.status().collect()} == {1: "moved", 2: "not_quoted"}


def test_a_delta_without_jobs_leaves_the_table_of_jobs(spark, tmp_path):
    layer = sinks.Layer(spark, f"{tmp_path}/layer")
    store = incremental.StatusStore(layer, buckets=2)
    jobs = spark.createDataFrame([(1, "a"), (2, "b")], "job_id long, job_name string")
    store.apply(jobs, spark.createDataFrame([(1, 1, "Quote", dt.date(2000, 12, 20))], ACTIVITY))
    store.apply(jobs.limit(0), spark.createDataFrame([(2, 2, "Quote", dt.date(2000, 12, 1))], ACTIVITY))
    assert len(os.listdir(f"{tmp_path}/layer/status_jobs")) == 1 and store.deltas() == 2
    assert {r.job_id: (r.job_name, r.is_quoted) for r in store.status().collect()} == {1: ("a", True), 2: ("b", True)}


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    r = random.Random(3)
    layer = sinks.Layer(spark, f"{tmp_path}/layer")
    rows = [(v[1], k, version, r.choice(KINDS), v[3]) for k, v in activities(4, 12).items() for version in range(3)]
    r.shuffle(rows)
    half = len(rows) // 2
    for part in (rows[:half], rows[half:] + rows[:10], rows[5:40]):
        for at in range(0, len(part), 25):
            spark.createDataFrame(part[at : at + 25], signals.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        signals.stream_signals(spark, f"{tmp_path}/events", layer, f"{tmp_path}/checkpoint", per_trigger=3, shards=2).awaitTermination()
    last = {}
    for job, k, version, kind, day in rows:
        strength = {"Quote": 3, "Measure": 2, "Template": 1}.get(kind, 0) if day and day <= views.AS_OF else 0
        strength = -1 if kind in views.MOVES and day else strength
        rank = (version, strength, (day - dt.date(1970, 1, 1)).days if day else 0)
        if k not in last or last[k][0] < rank:
            last[k] = (rank, (k, job, kind, day))
    batch = views.signal_facts(spark.createDataFrame([v for _, v in last.values()], ACTIVITY))
    jobs = spark.createDataFrame([(j, f"job {j}") for j in range(13)], "job_id long, job_name string")
    assert as_rows(views.status_of(jobs, signals.merged(layer.read("job_signals")))) == as_rows(views.status_of(jobs, batch))


def test_state_is_read_and_written_once_for_a_bucket_of_jobs(spark):
    import pandas as pd

    class Held:
        value, calls = None, []

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    held, p = Held(), signals.JobSignals()
    p.init(held)
    frame = pd.DataFrame({"job_id": range(4000), "activity_id": range(4000), "version": 1, "day": range(4000), "kind": [3, -1, 0, 1] * 1000})
    out = pd.concat(p.handleInputRows((0, 5), iter([frame[1000:], frame[:1000]]), None))
    assert held.calls == ["get", "update"] and sorted(out["job_id"]) == list(range(4000)) and set(out["shard"]) == {5}
    by = out.set_index("job_id")
    assert by.loc[8, ["first", "last", "move", "source"]].tolist() == [8, 8, signals.NONE, 3] and by.loc[9, ["first", "last", "move", "source"]].tolist() == [signals.NONE, signals.NONE, 9, 0]
    older, newer = frame.assign(version=0, kind=3)[:9], frame.assign(version=2, kind=1)[9:10]
    assert list(p.handleInputRows((0, 5), iter([frame, older]), None)) == [] and held.calls == ["get", "update", "get"]
    (last,) = p.handleInputRows((0, 5), iter([frame, newer]), None)
    assert last[["job_id", "first", "move", "source"]].values.tolist() == [[9, 9, signals.NONE, 1]]
