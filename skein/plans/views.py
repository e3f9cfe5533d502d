"""The curated views: functions from DataFrames to DataFrames, with the as-of date and the settling days as parameters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AS_OF = dt.date(2000, 12, 31)
SETTLE_DAYS = 30
#: The types that show a quote, strongest first, and those that show the job went ahead.
SIGNALS = ("Quote", "Measure", "Template")
MOVES = ("Install", "Removal")
PAID = ("%payment received —%", "%payment recorded —%", "%check-bot%")


def percent(part: Column, whole: Column) -> Column:
    """A percentage with one digit; null where the whole is 0."""
    return F.round(F.try_divide(part * F.lit(100.0), whole.cast("double")), 1)


def v_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs under their public names; the city is the normalised one, the raw one comes last."""
    return jobs.select("job_id", "job_name", F.col("account_name").alias("customer"), "salesperson", F.col("city_normalized").alias("city"), "process_name", F.col("job_status_name").alias("status"), "creation_date", F.col("city").alias("city_raw"))


def v_job_areas(areas: DataFrame, jobs: DataFrame) -> DataFrame:
    return areas.join(jobs.select("job_id", "job_name"), "job_id").select("job_id", "job_name", "area_name", "room_type", "sq_ft", "material_name", "supplier", "edge", "backsplash", "sink")


def v_invoices(invoices: DataFrame) -> DataFrame:
    return invoices.select("doc_number", "customer_name", "txn_date", "total_amt", "balance", "status")


def v_job_invoices(links: DataFrame, jobs: DataFrame, invoices: DataFrame) -> DataFrame:
    """Linked numbers of known jobs; numbers that no invoice has stay, with nulls."""
    known = invoices.select("doc_number", "txn_date", "total_amt", "balance", "status")
    return links.join(jobs.select("job_id", "job_name"), "job_id").join(known, "doc_number", "left").select("job_id", "job_name", "doc_number", "txn_date", "total_amt", "balance", "status")


def happened(as_of: dt.date = AS_OF) -> Column:
    """Dated and not after the as-of date; undated rows are placeholders."""
    return F.coalesce(F.col("activity_date") <= F.lit(as_of), F.lit(False))


def scheduled(as_of: dt.date = AS_OF) -> Column:
    return F.coalesce(F.col("activity_date") > F.lit(as_of), F.lit(False))


def assignee_lists(assignees: DataFrame) -> DataFrame:
    """One row for each activity with its assignees' names in order."""
    return assignees.groupBy("activity_id").agg(F.array_join(F.sort_array(F.collect_list("assignee_name")), ", ").alias("assignees"))


def v_activities(activities: DataFrame, assignees: DataFrame | None, jobs: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """Activities of known jobs; without a table of assignees the activities have the column already."""
    acts = activities.join(jobs.select("job_id", "job_name"), "job_id")
    if assignees is not None:
        acts = acts.join(assignee_lists(assignees), "activity_id", "left")
    return acts.select(
        "activity_id", "job_id", "job_name", "type_name", "status_name", "activity_date", "phase", "assignees", F.col("notes").alias("note"), happened(as_of).alias("happened"), scheduled(as_of).alias("is_scheduled_future")
    )


def v_job_sqft(areas: DataFrame) -> DataFrame:
    return areas.groupBy("job_id").agg(F.sum("sq_ft").alias("total_sq_ft"), F.count("*").alias("area_count"))


def signal_facts(activities: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """first_signal_date, last_signal_date, signal_source, had_dated_<signal> and first_move_date of each job with a dated signal or move.

    A signal is a quote, measure or template that happened; a move is an install or removal of any date. All facts of a job come
    from one aggregate over its activities, so the activities are shuffled once, after partial aggregation.
    """
    kind, day, at = F.col("type_name"), F.col("activity_date"), F.lit(as_of)
    signal = kind.isin(*SIGNALS) & (day <= at)
    strength = F.when(kind == SIGNALS[0], 3).when(kind == SIGNALS[1], 2).otherwise(1)
    return (
        activities.where(day.isNotNull() & kind.isin(*SIGNALS, *MOVES))
        .groupBy("job_id")
        .agg(
            F.min(F.when(signal, day)).alias("first_signal_date"),
            F.max(F.when(signal, day)).alias("last_signal_date"),
            F.max_by(F.lower(kind), F.when(signal, F.struct(day, strength))).alias("signal_source"),
            *[F.bool_or(signal & (kind == t)).alias(f"had_dated_{t.lower()}") for t in SIGNALS],
            F.min(F.when(kind.isin(*MOVES), day)).alias("first_move_date"),
        )
    )


def status_of(jobs: DataFrame, facts: DataFrame, as_of: dt.date = AS_OF, settle_days: int = SETTLE_DAYS) -> DataFrame:
    """The status of each job from its facts (signal_facts), however they were kept."""
    at = F.lit(as_of)
    s = jobs.select("job_id", "job_name").join(facts, "job_id", "left")
    quoted, moved = F.col("last_signal_date").isNotNull(), F.col("first_move_date").isNotNull()
    silent = F.datediff(at, F.col("last_signal_date"))
    return s.select(
        "job_id", "job_name", quoted.alias("is_quoted"), "first_signal_date", "last_signal_date",
        F.when(quoted, F.col("signal_source")).alias("signal_source"),
        *[F.coalesce(f"had_dated_{t.lower()}", F.lit(False)).alias(f"had_dated_{t.lower()}") for t in SIGNALS],
        moved.alias("moved_forward"), "first_move_date",
        F.coalesce(F.col("first_move_date") > at, F.lit(False)).alias("move_is_future"),
        F.when(quoted & ~moved, silent).alias("days_silent"),
        F.when(~quoted, "not_quoted").when(moved, "moved").when(silent <= settle_days, "pending").otherwise("quiet").alias("status"),
    )


def pipeline_status(jobs: DataFrame, activities: DataFrame, as_of: dt.date = AS_OF, settle_days: int = SETTLE_DAYS) -> DataFrame:
    """Where each job stands: not_quoted, moved, pending or quiet."""
    return status_of(jobs, signal_facts(activities, as_of), as_of, settle_days)


def conversion(cohorts: DataFrame, day: str) -> DataFrame:
    """Quoted jobs, moved ones and their share for each month of ``day``."""
    moved = F.count_if("moved_forward")
    return cohorts.groupBy(F.trunc(day, "MM").alias("quote_month")).agg(F.count("*").alias("quoted_jobs"), moved.alias("moved_forward"), percent(moved, F.count("*")).alias("conversion_pct"))


def settled(status: DataFrame, as_of: dt.date = AS_OF, settle_days: int = SETTLE_DAYS) -> DataFrame:
    """Quoted jobs old enough to be judged, and those that moved already."""
    return status.where(F.col("is_quoted") & ((F.col("first_signal_date") <= F.lit(as_of - dt.timedelta(settle_days))) | F.col("moved_forward")))


def v_quote_conversion_monthly(status: DataFrame, as_of: dt.date = AS_OF, settle_days: int = SETTLE_DAYS) -> DataFrame:
    return conversion(settled(status, as_of, settle_days), "first_signal_date")


def _paid(notes: Column) -> Column:
    out = notes.ilike(PAID[0])
    for pattern in PAID[1:]:
        out = out | notes.ilike(pattern)
    return F.coalesce(out, F.lit(False))


def quotes(activities: DataFrame, proxy: bool, as_of: dt.date = AS_OF, days: int = 7) -> DataFrame:
    """The older cohorts: job_id, first_quote_date, moved_forward.

    The cohort is the first dated quote; with ``proxy`` a job whose quotes are all undated counts from its first dated measure.
    Payment notes count as moves. One aggregate over the activities gives both sides.
    """
    kind, day = F.col("type_name"), F.col("activity_date")
    first_quote, first_measure = F.min(F.when(kind == "Quote", day)), F.min(F.when(kind == "Measure", day))
    n_quotes = F.count_if(kind == "Quote")
    first = F.when(n_quotes > 0, F.coalesce(first_quote, first_measure)) if proxy else first_quote
    moved = F.bool_or((kind.isin(*MOVES) & day.isNotNull()) | _paid(F.col("notes")))
    jobs = activities.groupBy("job_id").agg(first.alias("first_quote_date"), F.coalesce(moved, F.lit(False)).alias("moved_forward"))
    return jobs.where(F.col("first_quote_date").isNotNull() & ((F.col("first_quote_date") <= F.lit(as_of - dt.timedelta(days))) | F.col("moved_forward")))


def conversion_by_quotes(activities: DataFrame, proxy: bool, as_of: dt.date = AS_OF) -> DataFrame:
    return conversion(quotes(activities, proxy, as_of), "first_quote_date")


def by_year(monthly: DataFrame, label: str) -> DataFrame:
    """The yearly rate as a ratio of sums, never a mean of monthly rates."""
    moved, quoted = F.sum("moved_forward"), F.sum("quoted_jobs")
    return monthly.groupBy(F.year("quote_month").alias("quote_year")).agg(quoted.alias(f"quoted_{label}"), percent(moved, quoted).alias(f"pct_{label}"))


def conversion_side_by_side(activities: DataFrame, status: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """Each year's rate under the three definitions."""
    v2, v3 = (by_year(conversion_by_quotes(activities, p, as_of), n) for p, n in ((False, "v2"), (True, "v3")))
    return v2.join(v3, "quote_year", "full").join(by_year(v_quote_conversion_monthly(status, as_of), "v4"), "quote_year", "full")


def entry_path_conversion(status: DataFrame) -> DataFrame:
    """Quoted jobs by the kind of signal they have."""
    quote, measure, template = (F.col(f"had_dated_{t.lower()}") for t in SIGNALS)
    path = F.when(quote, "1. quote logged").when(measure & template, "2. measure + template, no quote").when(measure, "3. measure only").otherwise("4. TEMPLATE ONLY")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("moved", "pending", "quiet")]
    return status.where("is_quoted").groupBy(path.alias("entry_path")).agg(F.count("*").alias("quoted_jobs"), *counts, percent(F.count_if(F.col("status") == "moved"), F.count("*")).alias("conversion_pct"))


def quiet_jobs(status: DataFrame, jobs: DataFrame, canceled: str) -> DataFrame:
    """Quiet jobs that were not canceled; a job without a process name is in neither."""
    j = v_jobs(jobs).where(F.col("process_name") != canceled).select("job_id", "customer", "salesperson", "city", "process_name")
    return status.where(F.col("status") == "quiet").join(j, "job_id")


def recoverable(status: DataFrame, jobs: DataFrame, canceled: str = "Canceled") -> DataFrame:
    """Templated but never quoted quiet jobs, the freshest first."""
    rows = quiet_jobs(status, jobs, canceled).where("had_dated_template and not had_dated_quote")
    return rows.select("job_id", "job_name", "customer", "salesperson", "city", "process_name", "last_signal_date", "days_silent").orderBy(F.col("days_silent").asc_nulls_last(), "job_id")


def how_far_it_got(status: DataFrame, jobs: DataFrame, canceled: str = "Canceled") -> DataFrame:
    stage = F.when(F.col("had_dated_template"), "templated - money spent").when(F.col("had_dated_measure"), "measured").otherwise("quoted only")
    return quiet_jobs(status, jobs, canceled).groupBy(stage.alias("how_far_it_got")).agg(F.count("*").alias("quiet_jobs"), F.round(F.avg("days_silent")).alias("avg_days_silent"))


def crew_workload(activities: DataFrame, areas: DataFrame, crew: str = "crew_id", as_of: dt.date = AS_OF) -> DataFrame:
    """Jobs and square feet of each crew's installs that happened.

    Distinct (crew, job) pairs meet one row for each job, so that neither activities nor areas multiply; jobs without areas count.
    """
    pairs = activities.where((F.col("type_name") == "Install") & happened(as_of)).select(crew, "job_id").distinct()
    work = pairs.join(v_job_sqft(areas), "job_id", "left")
    return work.groupBy(crew).agg(F.count("*").alias("jobs"), F.sum("total_sq_ft").alias("total_sq_ft"), F.round(F.avg("total_sq_ft"), 2).alias("avg_sq_ft"))


def placeholder_diagnostic(activities: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """How many activities of each type happened, lie ahead or are undated placeholders."""
    dated = F.col("activity_date").isNotNull()
    return activities.groupBy("type_name").agg(
        F.count("*").alias("n"), F.count_if(dated).alias("dated"), F.count_if(~dated).alias("undated"),
        F.count_if(happened(as_of)).alias("happened"), F.count_if(scheduled(as_of)).alias("future"), percent(F.count_if(happened(as_of)), F.count("*")).alias("happened_pct"),
    )


def blank_free(rows: DataFrame, key: str) -> DataFrame:
    """Rows that may be ranked by ``key``: neither null nor blank."""
    return rows.where(F.col(key).isNotNull() & (F.trim(key) != ""))


def top_groups(rows: DataFrame, key: str, n: int, measure: Column, name: str) -> DataFrame:
    """The n groups with the largest measure, ties by key; blank keys do not compete."""
    return blank_free(rows, key).groupBy(key).agg(measure.alias(name)).orderBy(F.desc_nulls_last(name), F.asc(key)).limit(n)


def register(views: dict[str, DataFrame]) -> None:
    """Each view under its name in its own session."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
