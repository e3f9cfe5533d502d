"""Registered queries of ingestion, sinks, parsers, gates and the guarded lane, each with its SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import parsers
from skein.functions.stemming import stem
from skein.operators import blocks, derive, gates, retrieval
from skein.operators import chunks as ch
from skein.plans import incremental
from skein.plans import views as v
from skein.plans.guard import Guard
from skein.plans.registry import query
from skein.sources import ingest, sinks
from skein.sources.domain import Domain
from skein.sources.tables import kept, shared_dir
from skein.streaming import signals

#: Nested pages: one JSON text for each order, with its lines as activities and two forms. The values that SQL expects are stated beside it.
SQFT_TEXT = ("{} sf", " {}.5 ", "${} sq. ft.", "", "about {}")


def _page_texts(d: Domain, activities: DataFrame) -> DataFrame:
    c = F.col
    phases = F.when(c("phase").isNotNull(), F.array(F.struct(F.lit(2).alias("seqNum"), F.lit("second").alias("name")), F.struct(F.lit(1).alias("seqNum"), c("phase").alias("name"))))
    activity = F.struct(
        c("activity_id").alias("activityId"), c("type_name").alias("typeName"), c("status_name").alias("statusName"), F.date_format("activity_date", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), c("notes").alias("notes"),
        F.struct(phases.alias("jobPhases")).alias("extra"),
    )
    lines = activities.groupBy("job_id").agg(F.collect_list(activity).alias("activities"))
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    tick = lambda n: F.when(c("job_id") % n == 0, "1").otherwise("0")
    number = (c("job_id") % 200).cast("string")
    kind = c("job_id") % len(SQFT_TEXT)
    size = F.lit(None).cast("string")
    for i, text in enumerate(SQFT_TEXT):
        before, _, after = text.partition("{}")
        size = F.when(kind == i, F.concat(F.lit(before), number, F.lit(after)) if "{}" in text else F.lit(text)).otherwise(size)
    form = lambda given, name, template, *fields: F.struct(given.cast("bigint").alias("formId"), F.lit(name).alias("formName"), F.lit(template).alias("formTemplateName"), F.array(*fields).alias("fields"))
    forms = F.array(
        form(F.lit(None), "Summary", "Job Summary", field("Deposit received", tick(3)), field("Paid in Full", tick(5)), field("Notes", F.concat(F.lit("The client called about job "), c("job_id").cast("string")))),
        form(c("job_id") * 10 + 1, "", "Details", field("Sq Ft", size), field("Material Name", F.lit("old")), field("Material Name", c("process_name")), field("Edge", F.lit(""))),
    )
    job = F.struct(
        c("job_id").alias("jobId"), c("job_name").alias("jobName"), c("account_name").alias("accountName"), F.when(c("job_id") % 11 == 0, "n/a").otherwise(F.date_format("creation_date", "yyyy-MM-dd'T'HH:mm")).alias("creationDate"),
        c("salesperson").alias("salesperson"), F.struct(c("city").alias("city")).alias("address"), F.array(F.struct(c("account_name").alias("name"))).alias("contacts"), c("activities"), forms.alias("forms"),
    )
    return d.jobs.join(lines, "job_id", "left").select(F.to_json(F.struct(F.array(job).alias("jobs"))).alias("value"))


def _pages(d: Domain, once: bool = False) -> dict[str, DataFrame]:
    """once: the forms of the parsed pages are written once, for queries that read two of the tables made from them."""
    pages = ingest.parse_pages(_page_texts(d, d.keyed_activities))
    return ingest.split_pages(pages, lambda forms: kept(forms, "forms")) if once else ingest.split_pages(pages)


@query("SELECT job_id, job_name, account_name, CASE WHEN job_id % 11 <> 0 THEN creation_date END AS creation_date, salesperson, city FROM jobs", "jobs")
def ingested_jobs(d):
    return _pages(d)["jobs"].select("job_id", "job_name", "account_name", "creation_date", "salesperson", "city")


@query("SELECT job_id, account_name AS name FROM jobs", "jobs")
def ingested_contacts(d):
    return _pages(d)["job_contacts"].select("job_id", "name")


@query("SELECT activity_id, job_id, type_name, status_name, activity_date, CAST(length(notes) AS INTEGER) AS note_len, phase || ', second' AS phase FROM lines WHERE job_id IN (SELECT o_orderkey FROM orders)", "lines")
def ingested_activities(d):
    return _pages(d)["activities"].select("activity_id", "job_id", "type_name", "status_name", "activity_date", "note_len", "phase")


@query("SELECT -(o_orderkey * 1000) AS form_id, o_orderkey AS job_id, 'Job Summary' AS template, 3 AS field_count FROM orders UNION ALL SELECT o_orderkey * 10 + 1, o_orderkey, 'Details', 4 FROM orders")
def ingested_forms(d):
    """Forms without an id get a negative one from their job and place."""
    return _pages(d)["job_forms"].select("form_id", "job_id", F.col("form_template_name").alias("template"), "field_count")


@query("SELECT job_id, job_id % 3 = 0 AS deposit_received, job_id % 5 = 0 AS paid_in_full, false AS removal_ready FROM jobs", "jobs")
def ingested_summary(d):
    return _pages(d, once=True)["job_summary"].select("job_id", "deposit_received", "paid_in_full", "removal_ready")


AREAS = """SELECT job_id, job_id * 10 + 1 AS form_id, CAST(NULL AS VARCHAR) AS area_name, CASE job_id % 5 WHEN 0 THEN job_id % 200 WHEN 1 THEN job_id % 200 + 0.5 WHEN 2 THEN job_id % 200 END::DOUBLE AS sq_ft, process_name AS material_name, '' AS edge, job_id % 5 = 4 AS sq_ft_failed FROM jobs"""


@query(AREAS, "jobs")
def derived_areas(d):
    """Key/value forms as wide rows: the last of repeated fields counts, and square feet are parsed."""
    t = _pages(d)
    return derive.derive_areas(t["job_forms"], t["area_fields"]).select("job_id", "form_id", "area_name", "sq_ft", "material_name", "edge", "sq_ft_failed")


@query(
    """SELECT kind, count(*) AS n, count(sq_ft) AS parsed, count(*) FILTER (WHERE job_id % 5 = 4) AS failed, sum(sq_ft) AS total FROM (SELECT job_id, job_id % 5 AS kind,
    CASE job_id % 5 WHEN 0 THEN job_id % 200 WHEN 1 THEN job_id % 200 + 0.5 WHEN 2 THEN job_id % 200 END::DOUBLE AS sq_ft FROM jobs) GROUP BY kind""",
    "jobs",
)
def sqft_parse(d):
    """Square feet in all the ways that they are written."""
    a = derived_areas(d)
    return a.groupBy((F.col("job_id") % 5).alias("kind")).agg(F.count("*").alias("n"), F.count("sq_ft").alias("parsed"), F.count_if("sq_ft_failed").alias("failed"), F.sum("sq_ft").alias("total"))


#: Line summaries of invoices: a counted line, a name that has an x, a line without a count, one with none, and a cut one.
SHEET = """SELECT doc, line, name, qty, unit_price, amount, amount IS NULL AS failed FROM (SELECT CAST(o_orderkey AS VARCHAR) AS doc, o_orderkey % 4 + 1 AS q, o_orderkey % 1000 * 1000 + 250 AS a FROM orders WHERE o_orderkey % 7 <> 3),
    LATERAL (SELECT unnest([1, 2, 3, 4, 5]) AS line, unnest(['Top', 'A x B', 'Fee', 'None', NULL]) AS name, unnest([q, 3, NULL, 0, NULL])::DOUBLE AS qty, unnest([round(CAST(a AS DOUBLE) / q, 4), 3, NULL, NULL, NULL])::DOUBLE AS unit_price, unnest([a, 9, -20.5, 5, NULL])::DOUBLE AS amount)"""


def _sheet(d: Domain) -> DataFrame:
    """An invoice sheet of strings; every seventh row has no document number."""
    key, text = F.col("o_orderkey"), F.lit(None).cast("string")
    amount = F.format_number(key % 1000 * 1000 + 250, 2)
    summary = F.concat(F.lit("Top x"), (key % 4 + 1).cast("string"), F.lit(" $"), amount, F.lit(" | A x B x3.0 $9 | Fee $-20.50 | None x0 $5 | cut o…"))
    total = F.when(key % 5 == 0, "n/a").otherwise(F.format_string("%.2f", "o_totalprice"))
    return d.raw("orders").select(
        F.when(key % 7 != 3, key.cast("string")).alias("doc"), text.alias("qb_id"), F.lit("c").alias("customer"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("inv_date"), F.lit("soon").alias("due_date"), total.alias("total"),
        F.lit("0").alias("balance"), F.col("o_orderstatus").alias("status"), *[text.alias(n) for n in ("memo", "note", "email")], F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created"), text.alias("updated"), summary.alias("line_items"),
    )


@query(SHEET)
def line_item_parse(d):
    lines = ingest.split_invoices(_sheet(d))[1]
    return lines.select(F.col("doc_number").alias("doc"), "line", "name", "qty", "unit_price", "amount", "failed")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_number, CAST(o_orderdate AS DATE) AS txn_date, CAST(NULL AS DATE) AS due_date, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(printf('%.2f', o_totalprice) AS DOUBLE) END AS total_amt, o_orderdate AS qb_created FROM orders WHERE o_orderkey % 7 <> 3")
def sheet_invoices(d):
    return ingest.split_invoices(_sheet(d))[0].select("doc_number", "txn_date", "due_date", F.col("total_amt").cast("double").alias("total_amt"), "qb_created")


@query("SELECT activity_id, CAST(('0x' || substr(sha1(assignee_name), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT AS BIGINT) AS assignee_id, assignee_name FROM assignee", "assignee")
def assignee_pairs(d):
    """Names joined by commas, with blanks, empty ones and repeats, as distinct pairs."""
    rows = d.staffed_activities.select("activity_id", F.concat(F.col("assignees"), F.lit(" ,, "), F.col("assignees")).alias("assigned"))
    return ingest.assignee_pairs(rows)


@query("SELECT activity_id, assignee_name FROM assignee WHERE activity_id // 1000 IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)", "assignee")
def known_assignee_pairs(d):
    """Pairs of activities that were loaded; the others are dropped, up to a share of unknown ones."""
    loaded = d.keyed_activities.where(F.col("job_id") % 3 != 0).join(d.raw("orders").select(F.col("o_orderkey").alias("job_id")), "job_id", "left_semi")
    return derive.known_pairs(d.assignees, loaded, 0.5)


@query("SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN CAST(ts AS DATE) END AS day FROM events")
def first_date_parse(d):
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("  "), at)).when(F.col("event_id") % 3 == 1, F.substring(at, 1, 10)).otherwise(F.concat(F.lit("on "), at))
    return d.raw("events").select("event_id", parsers.first_date(text).alias("day"))


BUILT = """SELECT source_type, source_id, job_id, sha256(raw_text || sha256(facts)) AS text_hash FROM (
    SELECT 'area_note' AS source_type, job_id * 10 + 1 AS source_id, job_id, 'This area belongs to job ' || job_id || ' of ' || process_name AS raw_text, concat_ws('; ', job_facts,
        CASE WHEN job_id % 2 = 0 THEN 'this note is on the "Main" area' WHEN n_areas = 1 THEN 'this note is on the job''s single area (room type: Kitchen)' ELSE 'this note is on one of the job''s areas' END,
        CASE WHEN job_id % 2 = 0 THEN 'room type Kitchen' END, job_id % 200 || ' sq ft', 'area material ' || process_name) AS facts FROM f
    UNION ALL SELECT 'area_note', -(job_id * 1000), job_id, 'The client called about job ' || job_id, concat_ws('; ', job_facts, 'this note is the job''s summary-form notes') FROM f WHERE length('The client called about job ' || job_id) >= 25
    UNION ALL SELECT 'activity_note', activity_id, l.job_id, notes, concat_ws('; ', job_facts, 'this note is on a ' || type_name || ' activity', 'activity status ' || nullif(status_name, ''),
        CASE WHEN activity_date IS NULL THEN 'undated' ELSE 'dated ' || strftime(activity_date, '%Y-%m-%d') END, 'phase ' || phase) FROM lines l JOIN f ON f.job_id = l.job_id WHERE length(trim(notes)) >= 25)"""
JOB_FACTS = """SELECT j.job_id, process_name, concat_ws('; ', CASE WHEN job_name <> '' THEN 'Job "' || job_name || '"' ELSE 'Job ' || j.job_id END, 'in ' || nullif(city, ''), 'salesperson ' || nullif(salesperson, ''),
    CASE WHEN account_name <> '' AND account_name <> coalesce(job_name, '') THEN 'account ' || account_name END, 'process ' || nullif(process_name, ''), 'status ' || nullif(job_status_name, ''),
    'materials on this job: ' || materials) AS job_facts, coalesce(n_areas, 0) AS n_areas FROM jobs j LEFT JOIN (
    SELECT job_id, string_agg(DISTINCT material_name, ', ' ORDER BY material_name) FILTER (WHERE material_name <> '') AS materials, count(*) AS n_areas FROM areas GROUP BY 1) m ON m.job_id = j.job_id"""


@query(f"SELECT * FROM (WITH f AS ({JOB_FACTS}) {BUILT})", "lines jobs areas")
def chunk_build_all(d):
    """Chunks of all three sources: activities, areas (named, single, or one of many) and summary forms."""
    acts, c = d.keyed_activities, F.col
    t = _pages(d, True)
    even = c("job_id") % 2 == 0
    areas = d.jobs.select(
        "job_id", (c("job_id") * 10 + 1).alias("form_id"), F.when(even, "Main").alias("area_name"), F.lit("Kitchen").alias("room_type"), (c("job_id") % 200).cast("string").alias("sq_ft_raw"), c("process_name").alias("material_name"),
        F.lit(None).cast("string").alias("supplier"), F.concat(F.lit("This area belongs to job "), c("job_id").cast("string"), F.lit(" of "), c("process_name")).alias("notes"),
    )
    other = ch.area_notes(areas).unionByName(ch.summary_notes(t["job_forms"], t["area_fields"]))
    # lines lie by job once they are numbered, so their notes meet the facts where they are; the materials of both joins are written once
    facts = ch.facts_of(d.jobs, kept(ch.job_materials(d.job_areas), "materials"))
    return ch.finished(ch.activity_chunks(acts, facts).unionByName(ch.with_facts(other, facts))).select("source_type", "source_id", "job_id", "text_hash")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE 0 END AS price FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def upsert_rows(d):
    """The last write wins on the key."""
    o = d.raw("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return sinks.upsert(o.where("k % 2 = 0").withColumn("price", F.lit(0.0)), o.where("k % 3 = 0"), ["k"])


@query("SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT l_orderkey, l_linenumber + 100 FROM lineitem WHERE l_orderkey % 10 = 0")
def replaced_rows(d):
    """All rows of the keys touched go, also of those that have no new ones."""
    rows = d.raw("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    new = rows.where("k % 10 = 0").select("k", (F.col("n") + 100).alias("n"))
    return sinks.replace_by_key(rows, new, rows.where("k % 5 = 0"), ["k"])


def _layer(d: Domain) -> sinks.Layer:
    """A layer that was built and then upserted twice with the same rows, one run of which failed."""
    layer = sinks.Layer(d.spark, f"{shared_dir(d.spark)}/layer-{uuid.uuid4().hex}")
    nation = d.raw("nation").select("n_nationkey", "n_name")
    layer.rebuild("nation", nation)
    new = nation.where("n_nationkey % 4 = 0").withColumn("n_name", F.upper(F.concat("n_name", F.lit("!"))))
    for _ in range(2):
        layer.upsert("nation", new, ["n_nationkey"])
    try:
        with layer.run("nation"):
            raise ValueError("a run that fails leaves the version before it")
    except ValueError:
        pass
    return layer


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation")
def layer_after_rerun(d):
    return _layer(d).read("nation")


@query("SELECT 'failed' AS status, 1 AS runs, 0 AS rows_out, 1 AS errors UNION ALL SELECT 'ok', 3, 3 * (SELECT count(*) FROM nation), 0 UNION ALL SELECT 'running', 4, 0, 0")
def run_journal(d):
    j = _layer(d).journal()
    return j.groupBy("status").agg(F.count("*").alias("runs"), F.coalesce(F.sum("rows_out"), F.lit(0)).alias("rows_out"), F.count("error").alias("errors"))


@query("SELECT * FROM status", "status")
def status_after_deltas(d):
    """Pipeline status from a first build that lacks some activities, has others wrong or too many, and lacks jobs, after three deltas."""
    store = incremental.StatusStore(sinks.Layer(d.spark, f"{shared_dir(d.spark)}/skein-status-{uuid.uuid4().hex}"))
    acts = kept(d.keyed_activities.select("activity_id", "job_id", "type_name", "activity_date"), "activities")
    kind = F.col("activity_id") % 4
    moved = F.when(kind == 2, F.date_add("activity_date", 40)).otherwise(F.col("activity_date"))
    surplus = acts.where("job_id % 3 = 0").select((F.col("activity_id") + 500).alias("activity_id"), "job_id", F.lit("Install").alias("type_name"), F.lit("1994-01-01").cast("date").alias("activity_date"))
    late = F.col("job_id") % 10 == 7
    store.apply(d.jobs.where(~late), acts.where(kind != 1).withColumn("activity_date", moved).unionByName(surplus))
    store.apply(d.jobs.limit(0), acts.where(kind == 1))
    store.apply(d.jobs.limit(0), acts.where(kind == 2))
    store.apply(d.jobs.where(late), surplus.withColumn("deleted", F.lit(True)))
    return store.status()


@query("SELECT * FROM status", "status")
def status_from_stream(d):
    """Pipeline status from a stream of activities: old versions, a restart, then late, repeated and new rows."""
    root = f"{shared_dir(d.spark)}/skein-stream-{uuid.uuid4().hex}"
    layer = sinks.Layer(d.spark, f"{root}/layer")
    acts = kept(d.keyed_activities.select("job_id", "activity_id", F.lit(2).cast("long").alias("version"), "type_name", "activity_date"), "activities")
    old = acts.withColumns({"version": F.lit(1).cast("long"), "type_name": F.when(F.col("activity_id") % 3 == 0, "Install").otherwise(F.col("type_name")), "activity_date": F.date_sub("activity_date", 50)})
    half = F.col("activity_id") % 2 == 0
    for rows in (old.where(half).unionByName(acts.where(~half)), acts.unionByName(old.where(~half)).unionByName(acts.where(half))):
        rows.write.mode("append").parquet(f"{root}/events")
        signals.stream_signals(d.spark, f"{root}/events", layer, f"{root}/checkpoint").awaitTermination()
    return v.status_of(d.jobs, signals.merged(layer.read("job_signals")))


CITIES = "SELECT city, count(*) AS n, count(*) + (CASE WHEN city LIKE '%1' THEN 3 WHEN city LIKE '%2' THEN 2 ELSE 0 END) AS want FROM jobs GROUP BY city"


@query(
    f"SELECT 'city ' || coalesce(city, '(none)') AS gate, CAST(n AS DOUBLE) AS value, CAST(want AS DOUBLE) AS expected, abs(n - want) <= 2 AS ok FROM ({CITIES}) UNION ALL SELECT 'city total', CAST(sum(n) AS DOUBLE), CAST(sum(want) AS DOUBLE), abs(sum(n) - sum(want)) <= 5 FROM ({CITIES})",
    "jobs",
)
def city_gate(d):
    """Each city within two of what is expected, all within five."""
    name = F.col("city")
    want = d.jobs.groupBy("city").agg(F.count("*").alias("m")).select("city", (F.col("m") + F.when(name.like("%1"), 3).when(name.like("%2"), 2).otherwise(0)).alias("n"))
    return gates.group_counts(d.jobs, "city", want)


@query(
    """SELECT 'spend' AS gate, round(sum(round(value, 2)), 2) AS value, 100.0::DOUBLE AS expected, sum(round(value, 2)) <= 100 AS ok FROM events WHERE event_type = 'purchase' AND value >= 0
    UNION ALL SELECT 'facts', CAST(count(*) FILTER (WHERE source IS NULL) AS DOUBLE), 0, count(*) FILTER (WHERE source IS NULL) = 0 FROM documents UNION ALL SELECT 'jobs', CAST(count(*) AS DOUBLE), 1500, abs(count(*) - 1500) <= 10 FROM orders"""
)
def spend_coverage_and_counts(d):
    """Money that the journal's notes tell of, rows that lack something, and a number of rows with slack."""
    note = F.when(F.col("event_type") == "purchase", F.concat(F.lit("run; cost_usd="), F.format_string("%.2f", F.round("value", 2)), F.lit(" in_tokens=5"))).otherwise("no cost")
    spent = gates.spend(d.raw("events").where("value >= 0").select(note.alias("note")), 100.0).withColumn("value", F.round("value", 2))
    return gates.union([spent, gates.coverage(F.col("job_id").isNotNull(), d.chunks, "facts"), gates.row_count(d.raw("orders"), "jobs", 1500, 10)])


def _views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The eight views that generated SQL may use."""
    d = Domain(spark, sf_dir)
    status = v.pipeline_status(d.jobs, d.activities)
    return {
        "v_jobs": v.v_jobs(d.jobs), "v_job_areas": v.v_job_areas(d.job_areas, d.jobs), "v_invoices": v.v_invoices(d.invoices), "v_job_invoices": v.v_job_invoices(derive.link_invoices(d.keyed_activities), d.jobs, d.invoices),
        "v_activities": v.v_activities(d.staffed_activities, None, d.jobs), "v_job_sqft": v.v_job_sqft(d.areas), "v_job_pipeline_status": status, "v_quote_conversion_monthly": v.v_quote_conversion_monthly(status),
    }


def guard(d: Domain, timeout: float = 600.0) -> Guard:
    return Guard(d.spark, lambda session: _views(session, d.sf_dir), timeout=timeout)


#: The same views for the oracle.
VIEW_SQL = {
    "v_jobs": "SELECT job_id, job_name, account_name AS customer, salesperson, city, process_name, job_status_name AS status, creation_date FROM jobs",
    "v_job_areas": "SELECT a.job_id, material_name, sq_ft FROM areas a JOIN jobs j ON j.job_id = a.job_id",
    "v_invoices": "SELECT * FROM invoices",
    "v_activities": f"SELECT l.activity_id, l.job_id, type_name, activity_date, assignees, {'coalesce(activity_date <= DATE ' + chr(39) + '2000-12-31' + chr(39) + ', false)'} AS happened FROM lines l JOIN jobs j ON j.job_id = l.job_id LEFT JOIN (SELECT activity_id, string_agg(assignee_name, ', ' ORDER BY assignee_name) AS assignees FROM assignee GROUP BY 1) a ON a.activity_id = l.activity_id",
    "v_job_sqft": "SELECT * FROM sqft",
    "v_job_pipeline_status": "SELECT * FROM status",
    "v_quote_conversion_monthly": "SELECT CAST(date_trunc('month', first_signal_date) AS DATE) AS quote_month, count(*) AS quoted_jobs, count(*) FILTER (WHERE moved_forward) AS moved_forward FROM status WHERE is_quoted AND (first_signal_date <= DATE '2000-12-01' OR moved_forward) GROUP BY 1",
}
CREW_WORK = "SELECT DISTINCT assignees, job_id FROM v_activities WHERE type_name = 'Install' AND happened AND assignees IS NOT NULL AND activity_date >= DATE '1998-01-01' AND activity_date < DATE '1998-07-01'"
CREW = f"SELECT assignees AS item, {{}} AS value FROM ({CREW_WORK}) w LEFT JOIN v_job_sqft s ON s.job_id = w.job_id GROUP BY assignees"
YEAR_RATE = "SELECT {} AS item, round(100.0 * sum(moved_forward) / sum(quoted_jobs), 1) AS value FROM v_quote_conversion_monthly"
#: Structured questions as SQL over the views: by name, the answer's item and value.
SALES = {
    "jobs of one salesperson": "SELECT salesperson AS item, count(*) AS value FROM v_jobs WHERE salesperson = '1-URGENT' GROUP BY salesperson",
    "jobs of another salesperson": "SELECT salesperson AS item, count(*) AS value FROM v_jobs WHERE salesperson = '5-LOW' GROUP BY salesperson",
    "top salesperson": "SELECT salesperson AS item, count(*) AS value FROM v_jobs WHERE trim(salesperson) <> '' GROUP BY salesperson ORDER BY value DESC, item LIMIT 1",
    "jobs by a part of the name": "SELECT 'high' AS item, count(*) AS value FROM v_jobs WHERE salesperson ILIKE '%high%'",
    "all salespeople": "SELECT salesperson AS item, count(*) AS value FROM v_jobs WHERE trim(salesperson) <> '' GROUP BY salesperson",
    "invoiced in a year": "SELECT '1997' AS item, sum(total_amt) AS value FROM v_invoices WHERE year(txn_date) = 1997",
    "invoices of a year": "SELECT '1996' AS item, count(*) AS value FROM v_invoices WHERE year(txn_date) = 1996",
    "invoiced in all": "SELECT 'all' AS item, sum(total_amt) AS value FROM v_invoices",
    "open balance": "SELECT status AS item, sum(balance) AS value FROM v_invoices GROUP BY status",
    "growth between years": "SELECT CASE WHEN year(txn_date) = 1995 THEN 'from' ELSE 'to' END AS item, sum(total_amt) AS value FROM v_invoices WHERE year(txn_date) IN (1995, 1998) GROUP BY CASE WHEN year(txn_date) = 1995 THEN 'from' ELSE 'to' END",
    "best year": "SELECT CASE WHEN count(*) > 0 THEN 'best' END AS item, max(total) AS value FROM (SELECT year(txn_date) AS y, sum(total_amt) AS total FROM v_invoices GROUP BY year(txn_date)) t",
    "most frequent city": "SELECT city AS item, count(*) AS value FROM v_jobs WHERE trim(city) <> '' GROUP BY city ORDER BY value DESC, item LIMIT 1",
    "jobs of a city": "SELECT city AS item, count(*) AS value FROM v_jobs WHERE city IN ('NATION_1', 'NATION_7', 'NATION_12') GROUP BY city",
    "cities by name are not parts": "SELECT 'exact' AS item, count(*) AS value FROM v_jobs WHERE city = 'NATION_2'",
    "jobs without a city": "SELECT 'none' AS item, count(*) AS value FROM v_jobs WHERE city IS NULL OR trim(city) = ''",
}
WORK = {
    "areas without material": "SELECT 'none' AS item, count(*) AS value FROM v_job_areas WHERE material_name IS NULL OR trim(material_name) = ''",
    "material by jobs": "SELECT 'anvil' AS item, count(DISTINCT job_id) AS value FROM v_job_areas WHERE material_name ILIKE '%anvil%'",
    "most used material": "SELECT material_name AS item, count(DISTINCT job_id) AS value FROM v_job_areas GROUP BY material_name ORDER BY value DESC, item LIMIT 1",
    "most common activity type": "SELECT type_name AS item, count(*) AS value FROM v_activities GROUP BY type_name ORDER BY value DESC, item LIMIT 1",
    "repairs": "SELECT 'Repair' AS item, count(*) AS value FROM v_activities WHERE type_name = 'Repair'",
    "quotes": "SELECT 'Quote' AS item, count(*) AS value FROM v_activities WHERE type_name = 'Quote'",
    "jobs with a type of work": "SELECT 'Measure' AS item, count(DISTINCT job_id) AS value FROM v_activities WHERE type_name = 'Measure'",
    "quiet jobs": "SELECT status AS item, count(*) AS value FROM v_job_pipeline_status WHERE status = 'quiet' GROUP BY status",
    "quiet jobs of a material": "SELECT 'quiet' AS item, count(DISTINCT s.job_id) AS value FROM v_job_pipeline_status s JOIN v_job_areas a ON a.job_id = s.job_id WHERE s.status = 'quiet' AND a.material_name ILIKE '%ring%'",
    "crew with most square feet": CREW.format("sum(total_sq_ft)") + " ORDER BY value DESC NULLS LAST, item LIMIT 1",
    "crew with most jobs": CREW.format("count(*)") + " ORDER BY value DESC, item LIMIT 1",
    "largest average job": CREW.format("round(avg(total_sq_ft), 2)") + " ORDER BY value DESC NULLS LAST, item LIMIT 1",
    "jobs of crews": CREW.format("count(*)"),
    "square feet of crews in a month": f"SELECT assignees AS item, sum(total_sq_ft) AS value FROM ({CREW_WORK.replace('1998-07-01', '1998-02-01')}) w LEFT JOIN v_job_sqft s ON s.job_id = w.job_id WHERE assignees ILIKE '%1' GROUP BY assignees",
    "average job of one crew": f"SELECT min(assignees) AS item, round(avg(total_sq_ft), 2) AS value FROM ({CREW_WORK}) w LEFT JOIN v_job_sqft s ON s.job_id = w.job_id WHERE assignees = (SELECT max(assignees) FROM ({CREW_WORK}) x)",
    "two crews compared": f"SELECT assignees AS item, sum(total_sq_ft) / count(*) AS value FROM ({CREW_WORK}) w LEFT JOIN v_job_sqft s ON s.job_id = w.job_id WHERE assignees IN (SELECT max(assignees) FROM ({CREW_WORK}) x UNION ALL SELECT min(assignees) FROM ({CREW_WORK}) y) GROUP BY assignees",
    "square feet of crews": CREW.format("sum(total_sq_ft)"),
}
RATES = {
    "conversion in all": YEAR_RATE.format("'all'"),
    "conversion of one year": YEAR_RATE.format("'1997'") + " WHERE year(quote_month) = 1997",
    "conversion of another": YEAR_RATE.format("'1999'") + " WHERE year(quote_month) = 1999",
    "best full year": "SELECT CASE WHEN count(*) > 0 THEN 'best' END AS item, max(rate) AS value FROM (SELECT round(100.0 * sum(moved_forward) / sum(quoted_jobs), 1) AS rate FROM v_quote_conversion_monthly GROUP BY year(quote_month) HAVING sum(quoted_jobs) >= 10) t",
    "did one job move": "SELECT status AS item, CASE WHEN moved_forward THEN 1 ELSE 0 END AS value FROM v_job_pipeline_status WHERE job_id = 377",
}


def _answers_sql(questions: dict[str, str]) -> str:
    used = " ".join(questions.values())
    views = ", ".join(f"{n} AS ({s})" for n, s in VIEW_SQL.items() if n in used)
    return f"SELECT * FROM (WITH {views} " + " UNION ALL ".join(f"SELECT '{n}' AS question, item, CAST(value AS DOUBLE) AS value FROM ({s})" for n, s in questions.items()) + ")"


def _named(df: DataFrame, used: str) -> DataFrame:
    """``df`` with the columns whose names stand in ``used``; with all where there is none or a star that is not that of count(*)."""
    names = [c for c in df.columns if re.search(rf"\b{re.escape(c)}\b", used, re.I)]
    return df if not names or "*" in re.sub(r"(?i)count\(\*\)", "", used) else df.select(*names)


def _answers(d: Domain, questions: dict[str, str]) -> DataFrame:
    """All questions over views that are built and written once, with the columns that questions name."""
    used = " ".join(questions.values())
    lane, out = Guard(d.spark, lambda session: {n: kept(_named(df, used), n) for n, df in _views(session, d.sf_dir).items() if re.search(rf"\b{n}\b", used)}), None
    for name, sql in questions.items():
        one = lane.frame(sql).select(F.lit(name).alias("question"), "item", F.col("value").cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query(_answers_sql(SALES), "jobs invoices")
def answers_on_sales(d):
    """Questions on jobs, invoices and cities through the guarded lane."""
    return _answers(d, SALES)


@query(_answers_sql(WORK), "jobs lines areas assignee sqft status")
def answers_on_work(d):
    """Questions on activities, materials and crews through the guarded lane; jobs count once for each crew."""
    return _answers(d, WORK)


@query(_answers_sql(RATES), "status")
def answers_on_conversion(d):
    return _answers(d, RATES)


def _shown(d: Domain, sql: str) -> DataFrame:
    """The rows that the lane shows, at most its limit, with the true total."""
    found = guard(d).run(sql)
    return d.spark.createDataFrame([tuple(r) for r in found.rows], found.frame.schema).withColumn("total", F.lit(found.row_count).cast("long"))


@query("SELECT job_id, city, count(*) OVER () AS total FROM jobs WHERE salesperson = '1-URGENT' ORDER BY job_id LIMIT 200", "jobs")
def guarded_rows(d):
    """A list without a limit of its own is cut at 200 rows, with the true total beside it."""
    return _shown(d, "SELECT job_id, city FROM v_jobs WHERE salesperson = '1-URGENT' ORDER BY job_id")


@query("SELECT job_id, customer_name, count(*) OVER () AS total FROM (SELECT CAST(doc_number AS BIGINT) AS job_id, customer_name FROM invoices WHERE status = 'F') ORDER BY job_id LIMIT 250", "invoices")
def guarded_limit(d):
    """A limit of its own is kept, and the total is that without it."""
    return _shown(d, "```sql\nSELECT try_cast(doc_number AS bigint) AS job_id, customer_name FROM v_invoices WHERE status = 'F' ORDER BY job_id LIMIT 250;\n```")


#: Statements that generated SQL might be, with {} for a supplier's number, and what the guard makes of them.
STATEMENTS = (
    ("SELECT count(*) FROM v_jobs WHERE job_id > {}", "allowed"),
    ("DROP TABLE v_jobs_{}", "not a plain SELECT"),
    ("SELECT 1; SELECT {}", "not one readable statement"),
    ("SELECT * FROM orders_{}", "unknown table"),
    ("SELECT * FROM parquet.`/data/{}`", "unknown table"),
    ("SELECT java_method('java.lang.System', 'exit', {})", "function not allowed"),
    ("```sql\nSELECT job_id FROM v_jobs WHERE job_id = {};\n```", "allowed"),
    ("WITH v_jobs AS (SELECT {} AS job_id) SELECT * FROM v_jobs", "a WITH query takes the name of a view"),
    ("SELECT no_such_column_{} FROM v_jobs", "not resolved"),
    ("INSERT INTO v_jobs VALUES ({})", "not a plain SELECT"),
    ("", "empty query"),
    ("SELECT j.job_id FROM v_jobs j WHERE job_id IN (SELECT max(job_id) FROM v_invoices_{})", "unknown table"),
    ("SET x = {}", "not a plain SELECT"),
    ("SELECT * FROM range({})", "not allowed"),
    ("WITH w AS (SELECT job_id FROM v_jobs WHERE job_id < {}) SELECT count(*) FROM w", "allowed"),
)
VERDICTS = f"SELECT s_suppkey, list_value({', '.join(chr(39) + what + chr(39) for _, what in STATEMENTS)})[s_suppkey % {len(STATEMENTS)} + 1] AS verdict FROM supplier"


@query(VERDICTS)
def guard_verdicts(d):
    """What the guard makes of a statement for each supplier: of fifteen kinds, three are allowed."""
    key = F.col("s_suppkey")
    pattern = F.element_at(F.array(*[F.lit(sql) for sql, _ in STATEMENTS]), (key % len(STATEMENTS) + 1).cast("int"))
    lane = Guard(d.spark, lambda session: {"v_jobs": v.v_jobs(Domain(session, d.sf_dir).jobs)})
    return lane.verdicts(d.raw("supplier").select("s_suppkey", F.replace(pattern, F.lit("{}"), key.cast("string")).alias("sql"))).select("s_suppkey", "verdict")


PROBED = ("orders", "lineitem", "documents", "no_such_table")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, true AS found, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}' AND table_schema = 'main') AS n_columns, (SELECT count(*) FROM {t}) AS n_rows" for t in PROBED[:3]) + " UNION ALL SELECT 'no_such_table', false, NULL, NULL")
def catalog_probes(d):
    """Which tables a session has, with their columns and rows, and one that it has not."""
    session = d.spark.newSession()
    for t in PROBED[:3]:
        session.read.parquet(f"{d.sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    found = gates.probe(session, PROBED)
    return d.spark.createDataFrame([tuple(r) for r in found], "name string, found boolean, n_columns long, n_rows long")


#: Words in the forms that notes have, and their stems.
FORMS = {
    "click": ("click", "clicks clicked clicking click"), "error": ("error", "error errors errored erroring"), "purchase": ("purchas", "purchase purchases purchased purchasing"),
    "signup": ("signup", "signup signups signups signup"), "view": ("view", "views viewed viewing view"),
}
_FORM = "CASE event_type " + " ".join(f"WHEN '{e}' THEN ['" + "', '".join(forms.split()) + f"'][CAST(props->>'$.k' AS INTEGER) % 4 + 1]" for e, (_, forms) in FORMS.items()) + " END"
_STEM = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{stem}'" for e, (stem, _) in FORMS.items()) + " END"


def _forms(d: Domain) -> DataFrame:
    nth = F.from_json("props", "k int")["k"] % 4
    word = F.lit(None).cast("string")
    for e, (_, forms) in FORMS.items():
        word = F.when(F.col("event_type") == e, F.element_at(F.array(*[F.lit(w) for w in forms.split()]), nth + 1)).otherwise(word)
    return d.raw("events").select("event_id", "event_type", word.alias("word"))


@query(f"SELECT event_id, {_FORM} AS word, {_STEM} AS stem FROM events")
def stems_of_words(d):
    """Words in several forms with their stems."""
    return _forms(d).select("event_id", "word", stem("word").alias("stem"))


@query(f"SELECT e AS query_id, count(*) AS chunks, min(event_id) AS first_chunk FROM (SELECT event_id, event_type FROM events) JOIN (VALUES {', '.join(f'({i}, ' + chr(39) + e + chr(39) + ')' for i, e in enumerate(FORMS))}) t(e, event_type) USING (event_type) GROUP BY 1")
def stemmed_matches(d):
    """A question with a word in one form finds the notes that have it in any."""
    notes = _forms(d).select(F.col("event_id").alias("chunk_id"), F.concat(F.lit("the client "), F.col("word"), F.lit(" it on "), F.col("event_id").cast("string")).alias("raw_text"))
    kinds = F.create_map(*[F.lit(x) for i, e in enumerate(FORMS) for x in (e, i)])
    asked = d.raw("events").select("event_type").distinct().select(kinds[F.col("event_type")].cast("long").alias("query_id"), F.concat(F.regexp_replace("event_type", "e$", ""), F.lit("ing")).alias("query"))
    index = blocks.build(notes, only=retrieval.query_terms(asked))
    found = retrieval.matches(index.postings(retrieval.query_terms(asked)), asked)
    return found.where("matched = n_clauses").groupBy("query_id").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("first_chunk"))
