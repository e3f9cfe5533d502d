"""Registered queries over the curated views, derived tables and chunks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import parsers
from skein.operators import chunks as ch
from skein.operators import derive, gates
from skein.plans import views as v
from skein.plans.registry import PCT, query
from skein.sources.domain import Domain


def _status(d: Domain) -> DataFrame:
    return v.pipeline_status(d.jobs, d.activities)


@query("SELECT * FROM status", "status")
def pipeline_status_by_job(d):
    return _status(d)


@query("SELECT status, count(*) AS jobs, count(*) FILTER (WHERE move_is_future) AS future_moves FROM status GROUP BY status", "status")
def pipeline_status_buckets(d):
    return _status(d).groupBy("status").agg(F.count("*").alias("jobs"), F.count_if("move_is_future").alias("future_moves"))


CONVERTED = f"count(*) AS quoted_jobs, count(*) FILTER (WHERE moved_forward) AS moved_forward, {PCT.format('count(*) FILTER (WHERE moved_forward)', 'count(*)')} AS conversion_pct"
V4 = f"SELECT CAST(date_trunc('month', first_signal_date) AS DATE) AS quote_month, {CONVERTED} FROM status WHERE is_quoted AND (first_signal_date <= DATE '2000-12-01' OR moved_forward) GROUP BY 1"
OLD = f"""SELECT CAST(date_trunc('month', d) AS DATE) AS quote_month, {CONVERTED} FROM (SELECT q.job_id, d, p.job_id IS NOT NULL AS moved_forward FROM (%s) q LEFT JOIN paid p ON p.job_id = q.job_id
    WHERE d <= DATE '2000-12-24' OR p.job_id IS NOT NULL) GROUP BY 1"""
V3 = OLD % """SELECT job_id, coalesce(min(activity_date) FILTER (WHERE type_name = 'Quote'), min(activity_date) FILTER (WHERE type_name = 'Measure')) AS d FROM lines WHERE type_name IN ('Quote', 'Measure')
    GROUP BY job_id HAVING count(*) FILTER (WHERE type_name = 'Quote') > 0 AND count(activity_date) > 0"""
V2 = OLD % "SELECT job_id, min(activity_date) AS d FROM lines WHERE type_name = 'Quote' AND activity_date IS NOT NULL GROUP BY job_id"
YEARLY = f"SELECT CAST(year(quote_month) AS INTEGER) AS quote_year, CAST(sum(quoted_jobs) AS BIGINT) AS quoted_{{0}}, {PCT.format('sum(moved_forward)', 'sum(quoted_jobs)')} AS pct_{{0}} FROM ({{1}}) GROUP BY 1"


@query(V4, "status")
def conversion_monthly_v4(d):
    return v.v_quote_conversion_monthly(_status(d))


@query(YEARLY.format("v4", V4), "status")
def conversion_yearly_ratio_of_sums(d):
    return v.by_year(v.v_quote_conversion_monthly(_status(d)), "v4")


@query(V3, "lines paid")
def conversion_monthly_v3(d):
    return v.conversion_by_quotes(d.activities, True)


@query(V2, "lines paid")
def conversion_monthly_v2(d):
    return v.conversion_by_quotes(d.activities, False)


@query(f"SELECT * FROM ({YEARLY.format('v2', V2)}) FULL JOIN ({YEARLY.format('v3', V3)}) USING (quote_year) FULL JOIN ({YEARLY.format('v4', V4)}) USING (quote_year)", "status paid")
def conversion_side_by_side(d):
    return v.conversion_side_by_side(d.activities, _status(d))


@query(
    f"""SELECT CASE WHEN had_dated_quote THEN '1. quote logged' WHEN had_dated_measure AND had_dated_template THEN '2. measure + template, no quote' WHEN had_dated_measure THEN '3. measure only' ELSE '4. TEMPLATE ONLY' END AS entry_path,
    count(*) AS quoted_jobs, count(*) FILTER (WHERE status = 'moved') AS moved, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'quiet') AS quiet,
    {PCT.format("count(*) FILTER (WHERE status = 'moved')", 'count(*)')} AS conversion_pct FROM status WHERE is_quoted GROUP BY 1""",
    "status",
)
def entry_path_conversion(d):
    return v.entry_path_conversion(_status(d))


QUIET = "FROM status s JOIN jobs j ON j.job_id = s.job_id WHERE status = 'quiet' AND process_name <> 'BUILDING'"


@query(f"SELECT s.job_id, s.job_name, account_name AS customer, salesperson, city, process_name, last_signal_date, days_silent {QUIET} AND had_dated_template AND NOT had_dated_quote", "status jobs")
def recoverable_jobs(d):
    return v.recoverable(_status(d), d.jobs, "BUILDING")


@query(f"SELECT CASE WHEN had_dated_template THEN 'templated - money spent' WHEN had_dated_measure THEN 'measured' ELSE 'quoted only' END AS how_far_it_got, count(*) AS quiet_jobs, round(avg(days_silent)) AS avg_days_silent {QUIET} GROUP BY 1", "status jobs")
def how_far_it_got(d):
    return v.how_far_it_got(_status(d), d.jobs, "BUILDING")


HAPPENED, FUTURE = "coalesce(activity_date <= DATE '2000-12-31', false)", "coalesce(activity_date > DATE '2000-12-31', false)"


@query(
    f"SELECT type_name, count(*) AS n, count(activity_date) AS dated, count(*) - count(activity_date) AS undated, count(*) FILTER (WHERE {HAPPENED}) AS happened, count(*) FILTER (WHERE {FUTURE}) AS future, {PCT.format(f'count(*) FILTER (WHERE {HAPPENED})', 'count(*)')} AS happened_pct FROM lines GROUP BY 1",
    "lines",
)
def placeholder_diagnostic(d):
    return v.placeholder_diagnostic(d.activities)


@query(
    f"SELECT l.activity_id, l.job_id, job_name, type_name, status_name, activity_date, phase, assignees, notes AS note, {HAPPENED} AS happened, {FUTURE} AS is_scheduled_future FROM lines l JOIN jobs j ON j.job_id = l.job_id LEFT JOIN (SELECT activity_id, string_agg(assignee_name, ', ' ORDER BY assignee_name) AS assignees FROM assignee GROUP BY 1) a ON a.activity_id = l.activity_id",
    "lines jobs assignee",
)
def activities_with_assignees(d):
    return v.v_activities(d.staffed_activities, None, d.jobs)


@query("SELECT * FROM sqft", "sqft")
def job_sqft(d):
    return v.v_job_sqft(d.areas)


WORK = f"FROM (SELECT DISTINCT crew_id, job_id FROM lines WHERE type_name = 'Install' AND {HAPPENED}) w LEFT JOIN sqft s ON s.job_id = w.job_id"


@query(f"SELECT crew_id, count(*) AS jobs, sum(total_sq_ft) AS total_sq_ft, round(avg(total_sq_ft), 2) AS avg_sq_ft {WORK} GROUP BY 1", "lines sqft")
def crew_workload_fanout_safe(d):
    return v.crew_workload(d.activities, d.areas)


@query(f"SELECT crew_id, jobs, avg_sq_ft FROM (SELECT crew_id, count(*) AS jobs, round(avg(total_sq_ft), 2) AS avg_sq_ft {WORK} GROUP BY 1) ORDER BY avg_sq_ft DESC, crew_id LIMIT 10", "lines sqft")
def crew_avg_job_size(d):
    return v.crew_workload(d.activities, d.areas).select("crew_id", "jobs", "avg_sq_ft").orderBy(F.desc("avg_sq_ft"), "crew_id").limit(10)


@query("SELECT job_id, job_name, account_name AS customer, salesperson, city, process_name, job_status_name AS status, creation_date, city AS city_raw FROM jobs", "jobs")
def jobs_view(d):
    return v.v_jobs(d.jobs)


@query("SELECT a.job_id, job_name, area_name, room_type, sq_ft, material_name, supplier, edge, backsplash, sink FROM areas a JOIN jobs j ON j.job_id = a.job_id", "areas jobs")
def job_areas_view(d):
    return v.v_job_areas(d.job_areas, d.jobs)


@query("SELECT * FROM invoices", "invoices")
def invoices_view(d):
    return v.v_invoices(d.invoices)


@query("SELECT l.job_id, job_name, l.doc_number, txn_date, total_amt, balance, status FROM links l JOIN jobs j ON j.job_id = l.job_id LEFT JOIN invoices i ON i.doc_number = l.doc_number", "links jobs invoices")
def job_invoices_view(d):
    return v.v_job_invoices(derive.link_invoices(d.keyed_activities), d.jobs, d.invoices)


@query("SELECT * FROM links", "links")
def invoice_number_links(d):
    return derive.link_invoices(d.keyed_activities)


@query(
    "SELECT count(DISTINCT l.doc_number) AS distinct_linked, count(DISTINCT l.doc_number) FILTER (WHERE i.doc_number IS NOT NULL) AS in_invoices, count(DISTINCT l.doc_number) FILTER (WHERE i.doc_number IS NULL) AS not_in_invoices, count(DISTINCT i.doc_number) FILTER (WHERE l.doc_number IS NULL) AS unlinked_invoices FROM links l FULL JOIN invoices i ON i.doc_number = l.doc_number",
    "links invoices",
)
def link_reconciliation(d):
    return derive.link_report(derive.link_invoices(d.keyed_activities), d.invoices)


@query("SELECT doc_number FROM invoices i WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.doc_number = i.doc_number)", "links invoices")
def unlinked_invoices(d):
    return d.invoices.join(derive.link_invoices(d.keyed_activities), "doc_number", "left_anti").select("doc_number")


@query("SELECT salesperson, count(*) AS jobs FROM jobs WHERE trim(salesperson) <> '' GROUP BY 1 ORDER BY jobs DESC, salesperson LIMIT 5", "jobs")
def top_salespeople(d):
    return v.top_groups(d.jobs, "salesperson", 5, F.count("*"), "jobs")


@query("SELECT city, count(*) AS jobs, count(DISTINCT account_name) AS customers FROM jobs GROUP BY 1", "jobs")
def jobs_by_city(d):
    return d.jobs.groupBy("city").agg(F.count("*").alias("jobs"), F.countDistinct("account_name").alias("customers"))


@query("SELECT process_name, count(*) AS jobs FROM jobs WHERE process_name IS NOT NULL AND trim(process_name) <> '' GROUP BY 1", "jobs")
def blank_key_excluded(d):
    return v.blank_free(d.jobs, "process_name").groupBy("process_name").agg(F.count("*").alias("jobs"))


@query("SELECT CAST(year(txn_date) AS INTEGER) AS year, count(*) AS invoices, CAST(sum(total_amt) AS DOUBLE) AS revenue FROM invoices GROUP BY 1", "invoices")
def yearly_revenue(d):
    return d.invoices.groupBy(F.year("txn_date").alias("year")).agg(F.count("*").alias("invoices"), F.sum("total_amt").cast("double").alias("revenue"))


@query("SELECT year, revenue FROM (SELECT CAST(year(txn_date) AS INTEGER) AS year, CAST(sum(total_amt) AS DOUBLE) AS revenue FROM invoices GROUP BY 1) ORDER BY revenue DESC, year LIMIT 1", "invoices")
def best_year(d):
    return yearly_revenue(d).select("year", "revenue").orderBy(F.desc("revenue"), "year").limit(1)


@query("SELECT count(*) AS invoices, CAST(sum(total_amt) AS DOUBLE) AS revenue FROM invoices WHERE txn_date >= DATE '1997-01-01' AND txn_date < DATE '1998-01-01'", "invoices")
def invoiced_in_year(d):
    one = d.invoices.where((F.col("txn_date") >= F.lit("1997-01-01").cast("date")) & (F.col("txn_date") < F.lit("1998-01-01").cast("date")))
    return one.agg(F.count("*").alias("invoices"), F.sum("total_amt").cast("double").alias("revenue"))


@query("SELECT job_id, creation_date, count(*) OVER () AS total FROM jobs WHERE salesperson = '1-URGENT' ORDER BY creation_date DESC, job_id LIMIT 200", "jobs")
def list_with_total_count(d):
    rows = d.jobs.where(F.col("salesperson") == "1-URGENT").select("job_id", "creation_date")
    total = rows.agg(F.count("*")).scalar()  # a scalar subquery instead of a window that would gather all rows in one task
    return rows.select("*", total.alias("total")).orderBy(F.desc_nulls_last("creation_date"), "job_id").limit(200)


@query("SELECT job_id FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.job_id = j.job_id)", "jobs lines")
def jobs_without_activities(d):
    return d.jobs.select("job_id").join(d.activities.select("job_id"), "job_id", "left_anti")


@query("SELECT count(DISTINCT job_id) AS jobs FROM areas WHERE material_name ILIKE '%ANVIL%'", "areas")
def material_substring_distinct_jobs(d):
    return d.job_areas.where(F.col("material_name").ilike("%anvil%")).agg(F.countDistinct("job_id").alias("jobs"))


@query("SELECT material_name, count(DISTINCT job_id) AS jobs FROM areas WHERE trim(material_name) <> '' GROUP BY 1 ORDER BY jobs DESC, material_name LIMIT 10", "areas")
def top_materials(d):
    return v.top_groups(d.job_areas, "material_name", 10, F.countDistinct("job_id"), "jobs")


@query("SELECT type_name, count(*) AS n FROM lines GROUP BY 1 ORDER BY n DESC, type_name LIMIT 1", "lines")
def most_common_activity(d):
    return v.top_groups(d.activities, "type_name", 1, F.count("*"), "n")


@query("SELECT job_id, string_agg(DISTINCT material_name, ', ' ORDER BY material_name) FILTER (WHERE material_name <> '') AS materials, count(*) AS n_areas FROM areas GROUP BY 1", "areas")
def job_materials(d):
    return ch.job_materials(d.job_areas)


JOB_FACTS = """SELECT j.job_id, concat_ws('; ', CASE WHEN job_name <> '' THEN 'Job "' || job_name || '"' ELSE 'Job ' || j.job_id END, 'in ' || nullif(city, ''), 'salesperson ' || nullif(salesperson, ''),
    CASE WHEN account_name <> '' AND account_name <> coalesce(job_name, '') THEN 'account ' || account_name END, 'process ' || nullif(process_name, ''), 'status ' || nullif(job_status_name, ''),
    'materials on this job: ' || materials) AS job_facts, coalesce(n_areas, 0) AS n_areas FROM jobs j LEFT JOIN (
    SELECT job_id, string_agg(DISTINCT material_name, ', ' ORDER BY material_name) FILTER (WHERE material_name <> '') AS materials, count(*) AS n_areas FROM areas GROUP BY 1) m ON m.job_id = j.job_id"""


@query(JOB_FACTS, "jobs areas")
def fact_strings(d):
    return ch.job_facts(d.jobs, d.job_areas)


@query(
    f"""SELECT source_id, job_id, sha256(raw_text || sha256(facts)) AS text_hash, CAST(length(raw_text) // 4 AS INTEGER) AS token_count,
    regexp_matches(raw_text, '(?i)payment bot|backfill|check-bot|Payment recorded|Payment received|No movement in the job since|invoice-parsing fix') AS is_bot_generated
    FROM (SELECT activity_id AS source_id, l.job_id, notes AS raw_text, concat_ws('; ', job_facts, 'this note is on a ' || type_name || ' activity', 'activity status ' || nullif(status_name, ''),
    CASE WHEN activity_date IS NULL THEN 'undated' ELSE 'dated ' || strftime(activity_date, '%Y-%m-%d') END, 'phase ' || phase) AS facts FROM lines l JOIN ({JOB_FACTS}) f ON f.job_id = l.job_id WHERE length(trim(notes)) >= 25)""",
    "lines jobs areas",
)
def chunk_build(d):
    built = ch.finished(ch.activity_chunks(d.keyed_activities, ch.job_facts(d.jobs, d.job_areas)))
    return built.select("source_id", "job_id", "text_hash", "token_count", "is_bot_generated")


def _before(d: Domain) -> DataFrame:
    """Yesterday's chunks: notes of two sources have changed since, and one source was not there yet."""
    c = F.col
    old = d.chunks.where(c("job_id") != "src3").withColumn("raw_text", F.when(c("job_id").isin("src1", "src2"), F.concat("raw_text", F.lit("!"))).otherwise(c("raw_text")))
    return ch.finished(old).withColumn("context_text", F.concat(F.lit("about "), c("facts")))


@query("SELECT doc_id AS chunk_id, CASE WHEN source NOT IN ('src1', 'src2', 'src3') THEN 'about language ' || lang || '; source ' || source END AS context_text FROM documents")
def chunk_incremental_queue(d):
    return ch.merge_chunks(_before(d), ch.finished(d.chunks), ("chunk_id",)).select("chunk_id", "context_text")


@query("SELECT doc_id AS chunk_id FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def embed_staleness(d):
    return ch.stale(ch.finished(d.chunks), _before(d).select("chunk_id", "text_hash")).select("chunk_id")


@query("SELECT is_bot, count(*) AS n FROM (SELECT coalesce(regexp_matches(notes, '(?i)payment bot|backfill|check-bot|Payment recorded|Payment received|No movement in the job since|invoice-parsing fix'), false) AS is_bot FROM lines) GROUP BY 1", "lines")
def bot_flag_counts(d):
    return d.activities.groupBy(ch.is_bot(F.col("notes")).alias("is_bot")).agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT event_type, CAST(props->>'$.k' AS INTEGER) AS k FROM events) GROUP BY 1")
def json_field_totals(d):
    k = F.from_json("props", "k int")["k"]
    return d.raw("events").groupBy("event_type").agg(F.sum(k).alias("total"), F.max(k).alias("most"))


@query("SELECT user_id, string_agg(event_type, ', ' ORDER BY k, event_type) AS phases FROM (SELECT DISTINCT user_id, event_type, CAST(props->>'$.k' AS INTEGER) AS k FROM events) GROUP BY 1")
def json_phase_agg(d):
    rows = d.raw("events").select("user_id", F.struct(F.from_json("props", "k int")["k"].alias("k"), F.col("event_type").alias("name")).alias("p")).distinct()
    return rows.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["name"]), ", ").alias("phases"))


@query(
    """SELECT user_id, max_by(k, e) FILTER (WHERE event_type = 'click') AS click, max_by(k, e) FILTER (WHERE event_type = 'purchase') AS purchase, max_by(k, e) FILTER (WHERE event_type = 'view') AS view
    FROM (SELECT user_id, event_type, event_id AS e, props->>'$.k' AS k FROM events) GROUP BY 1"""
)
def eav_pivot(d):
    fields = d.raw("events").select("user_id", F.col("event_type").alias("field_name"), F.from_json("props", "k string")["k"].alias("field_value"), F.col("event_id").alias("place"))
    return derive.pivot_fields(fields, ["user_id"], {"click": "click", "purchase": "purchase", "view": "view"})


@query("SELECT user_id, bool_or(event_type = 'signup') AS signed_up, bool_or(event_type = 'purchase' AND value > 10) AS bought FROM events GROUP BY 1")
def summary_or_combine(d):
    return d.raw("events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "signup").alias("signed_up"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 10)).alias("bought"))


@query("SELECT s_name AS assignee_name, CAST(('0x' || substr(sha1(s_name), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT AS BIGINT) AS assignee_id FROM supplier")
def assignee_hash_ids(d):
    return d.raw("supplier").select(F.col("s_name").alias("assignee_name"), parsers.assignee_id(F.col("s_name")).alias("assignee_id"))


@query("SELECT doc_id, sha256(coalesce(text, '') || sha256(coalesce(source, ''))) AS text_hash, CAST(length(coalesce(text, '')) // 4 AS INTEGER) AS tokens FROM documents")
def text_hash(d):
    text = F.coalesce("text", F.lit(""))
    return d.raw("documents").select("doc_id", parsers.text_hash(text, F.coalesce("source", F.lit(""))).alias("text_hash"), parsers.token_estimate(text).alias("tokens"))


#: A small city dictionary over the nations' names; the codes are those of the contract's cascade.
CITY_NAMES = (("NATION_0", "Zero Town"), ("NATION_1", ""), ("NATION_2", derive.NEEDS_ZIP), ("NATION_3", derive.NEEDS_ZIP))
CITY_ADDRESSES = (("Account 7", "Seventh Street"), ("Account 70", "Seventieth Street"))
CITY_ZIPS = {"29407": "West Ashley", "29414": "West Ashley", "29412": "James Island"}
CITY_TYPOS = {"299407": "29407", "20407": "29407", "20414": "29414"}


@query(
    """SELECT job_id, CASE WHEN src = 'name_map' THEN 'Zero Town' WHEN src = 'zip' THEN CASE k WHEN 0 THEN 'West Ashley' ELSE 'James Island' END WHEN src = 'address_map' THEN street END AS city_normalized, src AS city_norm_source
    FROM (SELECT job_id, job_id % 3 AS k, CASE account_name WHEN 'Account 7' THEN 'Seventh Street' WHEN 'Account 70' THEN 'Seventieth Street' END AS street, CASE WHEN city = 'NATION_0' THEN 'name_map' WHEN city = 'NATION_1' THEN 'excluded'
    WHEN city IN ('NATION_2', 'NATION_3') AND job_id % 3 < 2 THEN 'zip' WHEN street IS NOT NULL THEN 'address_map' ELSE 'unresolved' END AS src FROM jobs)""",
    "jobs",
)
def city_resolution(d):
    zip_code = F.when(F.col("job_id") % 3 == 0, "299407").when(F.col("job_id") % 3 == 1, "29412-1234").otherwise("294")
    jobs = d.jobs.select("job_id", "city", F.col("account_name").alias("address_line1"), zip_code.alias("zip"))
    names, places = d.spark.createDataFrame(CITY_NAMES, "raw_city string, canonical_city string"), d.spark.createDataFrame(CITY_ADDRESSES, "address string, assigned_area string")
    return derive.normalise_cities(jobs, names, places, CITY_ZIPS, CITY_TYPOS).select("job_id", "city_normalized", "city_norm_source")


@query("SELECT (SELECT count(*) FROM orders) AS jobs, (SELECT count(*) FROM lineitem) AS activities, (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS vectors")
def reconciliation_counts(d):
    counts = [d.raw(t).select(F.lit(n).alias("t")) for n, t in (("jobs", "orders"), ("activities", "lineitem"), ("chunks", "documents"), ("vectors", "embeddings"))]
    rows = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
    return rows.agg(*[F.count_if(F.col("t") == n).alias(n) for n in ("jobs", "activities", "chunks", "vectors")])


@query("SELECT min(activity_date) AS first_activity, max(activity_date) AS last_activity, count(activity_date) AS dated FROM lines", "lines")
def date_ranges(d):
    return d.activities.agg(F.min("activity_date").alias("first_activity"), F.max("activity_date").alias("last_activity"), F.count("activity_date").alias("dated"))


@query(
    "SELECT 'activities of unknown jobs' AS gate, CAST(count(*) AS DOUBLE) AS value, 0.0::DOUBLE AS expected, count(*) = 0 AS ok FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'repeated job ids', CAST(count(*) AS DOUBLE), 0.0::DOUBLE, count(*) = 0 FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'vector length', CAST(count(*) FILTER (WHERE len(embedding) <> 64) AS DOUBLE), 0.0::DOUBLE, count(*) FILTER (WHERE len(embedding) <> 64) = 0 FROM embeddings UNION ALL SELECT 'buckets', CAST(count(*) AS DOUBLE), CAST(count(*) AS DOUBLE), true FROM orders"
)
def orphan_gate(d):
    buckets = pipeline_status_buckets(d)
    return gates.union([gates.no_orphans(d.activities, d.jobs, "job_id", "activities of unknown jobs"), gates.unique_key(d.raw("orders"), ["o_orderkey"], "repeated job ids"), gates.vector_length(d.embeddings, 64), gates.parts_sum_up(buckets, "jobs", d.raw("orders"), "buckets")])
