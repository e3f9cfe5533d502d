"""Readers of raw exports: nested JSON pages and CSV files, split into typed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.parsers import assignee_id, first_date, form_id, line_items, strip

PAGE_SCHEMA = """jobs array<struct<
  jobId bigint, jobName string, accountId bigint, accountName string, processId bigint, processName string, jobStatusId bigint,
  jobStatusName string, creationDate string, salesperson string, specialComment string, jobNotes string, jobUrl string,
  address struct<line1 string, line2 string, city string, state string, zip string, raw string>,
  contacts array<struct<name string, phone string, cell string, email string>>,
  activities array<struct<activityId bigint, typeId bigint, typeName string, statusId bigint, statusName string, date string,
    time string, duration string, notes string, extra struct<jobPhases array<struct<id bigint, name string, seqNum int>>>>>,
  forms array<struct<formId bigint, formName string, formTemplateName string, fieldCount int,
    fields array<struct<name string, value string, dataType string>>>>>>"""

#: The check boxes of a job's summary form.
SUMMARY_FIELDS = {
    "Deposit received": "deposit_received",
    "Paid in Full": "paid_in_full",
    "Removal Ready": "removal_ready",
    "Template Ready": "template_ready",
    "Sink in the shop": "sink_in_shop",
    "Material Ordered": "material_ordered",
    "Material Received": "material_received",
}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row for each job of the pages under ``path``, its nested parts still inside; a byte-order mark is skipped."""
    pages = spark.read.schema(PAGE_SCHEMA).option("multiLine", True).json(path)
    return pages.select(F.explode("jobs").alias("job"))


def parse_pages(texts: DataFrame) -> DataFrame:
    """The same from a column ``value`` with the text of a page in each row."""
    pages = texts.select(F.from_json(F.ltrim(F.col("value"), F.lit("\ufeff")), PAGE_SCHEMA).alias("page"))
    return pages.select(F.explode("page.jobs").alias("job"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, quoted cells over several lines and perhaps a byte-order mark; columns go by place."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', enforceSchema=True)


def phases(extra: Column) -> Column:
    """The phases' names in order of their numbers; null if there are none."""
    ordered = F.array_sort(F.transform(extra["jobPhases"], lambda p: F.struct(p["seqNum"].alias("n"), p["name"].alias("name"))))
    return F.when(F.size(ordered) > 0, F.array_join(F.transform(ordered, lambda p: p["name"]), ", "))


def split_pages(pages: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda forms: forms) -> dict[str, DataFrame]:
    """The six tables of read_pages(): jobs, job_contacts, activities, job_forms, area_fields and job_summary.

    keep: what is done with the forms, which the last three tables are made from, as writing them once.
    """
    j = F.col("job")
    jobs = pages.select(
        j.jobId.alias("job_id"), j.jobName.alias("job_name"), j.accountId.alias("account_id"), j.accountName.alias("account_name"),
        j.processId.alias("process_id"), j.processName.alias("process_name"), j.jobStatusId.alias("job_status_id"),
        j.jobStatusName.alias("job_status_name"), first_date(j.creationDate).alias("creation_date"), j.salesperson.alias("salesperson"),
        j.specialComment.alias("special_comment"), j.jobNotes.alias("job_notes"), j.jobUrl.alias("job_url"),
        j.address.line1.alias("address_line1"), j.address.line2.alias("address_line2"), j.address.city.alias("city"),
        j.address.state.alias("state"), j.address.zip.alias("zip"), j.address.raw.alias("address_raw"), F.to_json(j).alias("raw"),
    )
    contacts = pages.select(j.jobId.alias("job_id"), F.explode(j.contacts).alias("c")).select("job_id", "c.*")
    acts = pages.select(j.jobId.alias("job_id"), F.explode(j.activities).alias("a"))
    a = F.col("a")
    activities = acts.select(
        a.activityId.alias("activity_id"), "job_id", a.typeId.alias("type_id"), a.typeName.alias("type_name"), a.statusId.alias("status_id"),
        a.statusName.alias("status_name"), first_date(F.nullif(a.date, F.lit(""))).alias("activity_date"), a.time.alias("activity_time"),
        a.duration.alias("duration"), a.notes.alias("notes"), F.length(a.notes).alias("note_len"), phases(a.extra).alias("phase"), F.to_json(a).alias("raw"),
    )
    f = F.col("f")
    forms = keep(pages.select(j.jobId.alias("job_id"), F.posexplode(j.forms).alias("ordinal", "f"))).withColumn("form_id", form_id(f.formId, F.col("job_id"), F.col("ordinal")))
    fields = forms.select("form_id", "job_id", F.col("f.formTemplateName").alias("template"), F.posexplode("f.fields").alias("place", "v"))
    job_forms = forms.select(
        "form_id", "job_id", f.formName.alias("form_name"), f.formTemplateName.alias("form_template_name"),
        F.coalesce(f.fieldCount, F.coalesce(F.size(f.fields), F.lit(0))).alias("field_count"),
    )
    area_fields = fields.select("form_id", "job_id", "place", F.col("v.name").alias("field_name"), F.col("v.value").alias("field_value"), F.col("v.dataType").alias("data_type"))
    return {"jobs": jobs, "job_contacts": contacts, "activities": activities, "job_forms": job_forms, "area_fields": area_fields, "job_summary": job_summary(job_forms, area_fields)}


def job_summary(job_forms: DataFrame, area_fields: DataFrame, boxes: dict[str, str] = SUMMARY_FIELDS) -> DataFrame:
    """One row for each job with a summary form; a box is ticked if any such form of the job has it at '1'."""
    forms = job_forms.where(F.col("form_template_name") == "Job Summary").select("form_id", "job_id")
    rows = forms.join(area_fields.select("form_id", "field_name", "field_value"), "form_id", "left")
    ticked = [F.coalesce(F.bool_or((F.col("field_name") == name) & (F.col("field_value") == "1")), F.lit(False)).alias(col) for name, col in boxes.items()]
    return rows.groupBy("job_id").agg(*ticked)


def split_invoices(sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """invoices and invoice_lines of a sheet of 14 columns, all strings; rows without a document number are skipped."""
    rows = sheet.where(F.col("doc").isNotNull())
    invoices = rows.select(
        F.col("doc").alias("doc_number"), "qb_id", F.col("customer").alias("customer_name"), first_date(F.col("inv_date")).alias("txn_date"),
        first_date(F.col("due_date")).alias("due_date"), F.col("total").try_cast("decimal(18,2)").alias("total_amt"), F.col("balance").try_cast("decimal(18,2)").alias("balance"),
        "status", F.col("memo").alias("customer_memo"), F.col("note").alias("private_note"), F.col("email").alias("bill_email"),
        F.col("created").try_cast("timestamp").alias("qb_created"), F.col("updated").try_cast("timestamp").alias("qb_updated"), F.col("line_items").alias("line_summary_raw"),
    )
    lines = rows.select(F.col("doc").alias("doc_number"), F.explode(line_items(F.col("line_items"))).alias("l")).select("doc_number", "l.*")
    return invoices, lines


def assignee_pairs(rows: DataFrame) -> DataFrame:
    """(activity_id, assignee_id, assignee_name) of rows with names joined by commas; repeated pairs are dropped."""
    names = rows.select(F.col("activity_id"), F.explode(F.split("assigned", ",")).alias("n")).withColumn("assignee_name", strip(F.col("n")))
    return names.where("assignee_name != ''").select("activity_id", assignee_id(F.col("assignee_name")).alias("assignee_id"), "assignee_name").dropDuplicates(["activity_id", "assignee_id"])
