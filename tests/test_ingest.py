"""Pages, sheets, sinks and the stream: splitting, upserts, replacing, journal and reruns."""

import json

import pytest

from skein.operators import derive
from skein.sources import ingest, sinks
from skein.streaming.pages import load, stream_pages


def page(job, name="Job", phone="1", notes="see invoice #4556", box="1"):
    return {
        "jobs": [
            {
                "jobId": job, "jobName": name, "creationDate": "2020-02-03T00:00:00", "address": {"city": "X", "zip": "29412"},
                "contacts": [{"name": "C", "phone": phone}],
                "activities": [{"activityId": job * 10, "typeName": "Quote", "date": "", "notes": notes, "extra": {"jobPhases": [{"name": "b", "seqNum": 2}, {"name": "a", "seqNum": 1}]}}],
                "forms": [
                    {"formName": "K", "formTemplateName": "Details", "fields": [{"name": "Sq Ft", "value": "50"}, {"name": "Sq Ft", "value": "72 sf"}, {"name": "Other", "value": "z"}]},
                    {"formId": job * 100, "formTemplateName": "Job Summary", "fields": [{"name": "Paid in Full", "value": box}, {"name": "Notes", "value": ""}]},
                    {"formId": job * 100 + 1, "formTemplateName": "Job Summary", "fields": [{"name": "Paid in Full", "value": "0"}]},
                ],
            }
        ]
    }


def write(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(b"\xef\xbb\xbf" + json.dumps(data).encode())


def test_pages(spark, tmp_path):
    write(tmp_path / "in", "1.json", page(7))
    write(tmp_path / "in", "2.json", page(8, notes=None, box="0"))
    t = ingest.split_pages(ingest.read_pages(spark, str(tmp_path / "in")))
    assert [r.creation_date.isoformat() for r in t["jobs"].collect()] == ["2020-02-03"] * 2
    acts = {r.activity_id: r for r in t["activities"].collect()}
    assert acts[70].phase == "a, b" and acts[70].activity_date is None and acts[80].notes is None
    assert {r.form_id for r in t["job_forms"].collect()} == {-7000, 700, 701, -8000, 800, 801}
    assert {r.job_id: r.paid_in_full for r in t["job_summary"].collect()} == {7: True, 8: False}
    areas = {r.job_id: r for r in derive.derive_areas(t["job_forms"], t["area_fields"]).collect()}
    assert areas[7].sq_ft == 72.0 and areas[7].sq_ft_raw == "72 sf" and not areas[7].sq_ft_failed
    assert [tuple(r) for r in derive.link_invoices(t["activities"], "Quote").collect()] == [(7, "4556", 70)]
    assert derive.link_invoices(t["activities"]).isEmpty()


def test_csv_with_mark_and_lines(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes('﻿id,question\n1,"two\nlines, ""quoted"""\n'.encode())
    assert [tuple(r) for r in ingest.read_csv(spark, str(tmp_path / "g.csv"), "id int, question string").collect()] == [(1, 'two\nlines, "quoted"')]


def test_invoices_and_assignees(spark):
    cols = "doc qb_id customer inv_date due_date total balance status memo note email line_items created updated".split()
    rows = [("10", "q", "c", "2020-01-02", "", "12.5", "x", "s", None, None, None, "Top x2 $10 | bad", None, None), (None, *["z"] * 13)]
    inv, lines = ingest.split_invoices(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)))
    (one,) = inv.collect()
    assert (one.doc_number, str(one.total_amt), one.balance, one.due_date, one.txn_date.isoformat()) == ("10", "12.50", None, None, "2020-01-02")
    assert [(r.line, r.failed) for r in lines.orderBy("line").collect()] == [(1, False), (2, True)]
    pairs = ingest.assignee_pairs(spark.createDataFrame([(1, "Ann, Bob,,Ann"), (2, None), (3, "Bob")], "activity_id bigint, assigned string"))
    assert sorted((r.activity_id, r.assignee_name) for r in pairs.collect()) == [(1, "Ann"), (1, "Bob"), (3, "Bob")]
    acts = spark.createDataFrame([(1,)], "activity_id bigint")
    with pytest.raises(ValueError):
        derive.known_pairs(pairs, acts)
    assert derive.known_pairs(pairs, acts, 0.5).count() == 2


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (None, "C"), (3, "D")], "k int, v string")
    assert sorted(map(str, (tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()))) == sorted(map(str, [(1, "a"), (2, "B"), (None, "C"), (3, "D")]))
    got = sinks.replace_by_key(old.where("k is not null"), new.where("k = 3"), spark.createDataFrame([(1,), (3,)], "k int"), ["k"])
    assert sorted(tuple(r) for r in got.collect()) == [(2, "b"), (3, "D")]


def test_layer_and_journal(spark, tmp_path):
    layer = sinks.Layer(spark, str(tmp_path / "layer"))
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert layer.read("t", df.schema).count() == 0
    layer.upsert("t", df, ["k"])
    layer.upsert("t", df.unionByName(spark.createDataFrame([(2, "b")], df.schema)), ["k"])
    assert sorted(tuple(r) for r in layer.read("t").collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ZeroDivisionError), layer.run("t"):
        1 / 0
    assert layer.read("t").count() == 2
    assert {r.status: r["count"] for r in layer.journal().groupBy("status").count().collect()} == {"running": 3, "ok": 2, "failed": 1}


def test_stream_and_rerun(spark, tmp_path):
    src, layer = tmp_path / "in", sinks.Layer(spark, str(tmp_path / "layer"))
    write(src, "1.json", page(7))
    stream_pages(spark, str(src), layer, str(tmp_path / "cp")).awaitTermination(120)
    write(src, "2.json", page(7, name="New", phone="2"))
    write(src, "3.json", page(8))
    stream_pages(spark, str(src), layer, str(tmp_path / "cp")).awaitTermination(120)
    assert {r.job_id: r.job_name for r in layer.read("jobs").collect()} == {7: "New", 8: "Job"}
    assert sorted((r.job_id, r.phone) for r in layer.read("job_contacts").collect()) == [(7, "2"), (8, "1")]
    before = {n: sorted(map(str, layer.read(n).collect())) for n in ("jobs", "activities", "job_forms", "area_fields", "job_contacts", "job_summary")}
    load(layer, ingest.read_pages(spark, str(src / "[23].json")))
    assert before == {n: sorted(map(str, layer.read(n).collect())) for n in before}


def test_the_summary_builds_and_parses_the_pages_once(spark):
    import os

    from skein.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    if os.path.isdir(sf):
        plan = QUERIES["ingested_summary"](spark, sf)._jdf.queryExecution().toString()
        assert "from_json" not in plan and "l_orderkey" not in plan
