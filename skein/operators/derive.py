"""Derived tables: key/value forms to wide rows, links from notes to invoices, normalised cities, first and last rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.parsers import clean_zip, invoice_numbers, resolve_zip, square_feet, strip

#: The fields of an area form and their columns.
AREA_FIELDS = {
    "Room type": "room_type",
    "Sq Ft": "sq_ft_raw",
    "Material Name": "material_name",
    "Supplier": "supplier",
    "Sink": "sink",
    "Sink Types": "sink_types",
    "Sink Installed As": "sink_installed_as",
    "Edge": "edge",
    "Backsplash": "backsplash",
    "Faucet info": "faucet_info",
    "Removal": "removal",
    "Brackets": "brackets",
    "HLF": "hlf",
    "Reference:": "reference",
    "Notes": "notes",
}
NEEDS_ZIP = "CHARLESTON_NEEDS_ZIP"


def pivot_fields(fields: DataFrame, keys: list[str], names: dict[str, str], order: str = "place") -> DataFrame:
    """One row for each key with a column for each named field; of repeated fields the last by ``order`` counts.

    Conditional aggregates over a stated list of fields: one shuffle, and no pass to find the field names. A key none of whose
    fields is named keeps its row.
    """
    last = [F.max_by("field_value", F.when(F.col("field_name") == name, F.col(order))).alias(col) for name, col in names.items()]
    return fields.groupBy(*keys).agg(*last)


def derive_areas(forms: DataFrame, fields: DataFrame) -> DataFrame:
    """Area forms as wide rows with the square feet parsed; sq_ft_failed marks texts that are no number."""
    details = forms.where(F.col("form_template_name") == "Details").select("form_id", "job_id", "form_name")
    wide = pivot_fields(fields.select("form_id", "field_name", "field_value", "place"), ["form_id"], AREA_FIELDS)
    rows = details.join(wide, "form_id").withColumn("q", square_feet(F.col("sq_ft_raw")))
    return rows.select("job_id", "form_id", F.nullif("form_name", F.lit("")).alias("area_name"), F.col("q.sq_ft").alias("sq_ft"), *AREA_FIELDS.values(), F.col("q.failed").alias("sq_ft_failed"))


def link_invoices(activities: DataFrame, type_name: str = "Invoice") -> DataFrame:
    """(job_id, doc_number, activity_id): each number that the notes of a job's invoice activities name, with the first that does."""
    found = activities.where((F.col("type_name") == type_name) & (F.col("notes") != "")).select("job_id", "activity_id", F.explode(invoice_numbers(F.col("notes"))).alias("n"))
    return found.groupBy("job_id", F.col("n").cast("string").alias("doc_number")).agg(F.min("activity_id").alias("activity_id"))


def link_report(links: DataFrame, invoices: DataFrame) -> DataFrame:
    """One row: distinct numbers linked, those that invoices have, those they do not, and invoices without a link."""
    numbers, docs = links.select("doc_number").distinct().withColumn("linked", F.lit(1)), invoices.select("doc_number").distinct().withColumn("known", F.lit(1))
    both = numbers.join(docs, "doc_number", "full")
    return both.agg(
        F.count("linked").alias("distinct_linked"), F.count_if(F.col("linked").isNotNull() & F.col("known").isNotNull()).alias("in_invoices"),
        F.count_if(F.col("known").isNull()).alias("not_in_invoices"), F.count_if(F.col("linked").isNull()).alias("unlinked_invoices"),
    )


def map_of(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair]) if values else F.create_map().cast("map<string,string>")


def normalise_cities(jobs: DataFrame, name_map: DataFrame, address_map: DataFrame, zip_areas: dict[str, str], zip_typos: dict[str, str], needs_zip: str = NEEDS_ZIP) -> DataFrame:
    """``jobs`` with city_normalized and city_norm_source: name_map, zip, address_map, excluded, unresolved or null (no city).

    ``name_map`` (raw_city, canonical_city) is looked up by the untrimmed city; an empty canonical city excludes, and
    ``needs_zip`` asks for the zip code. Whatever is still open goes by ``address_map`` (address, assigned_area). Both are
    dictionaries, so Spark may broadcast them when their size allows.
    """
    areas, typos = map_of(zip_areas), map_of(zip_typos)
    names = name_map.groupBy(F.col("raw_city").alias("city")).agg(F.any_value("canonical_city").alias("canonical"))
    addresses = address_map.groupBy(F.col("address").alias("address_line1")).agg(F.any_value("assigned_area").alias("assigned"))
    j = jobs.join(names, "city", "left").join(addresses, "address_line1", "left")
    j = j.withColumn("found_zip", F.when(F.col("canonical") == needs_zip, resolve_zip(F.col("zip"), F.col("city"), areas, typos)))
    has_city = F.coalesce(strip(F.col("city")) != "", F.lit(False))
    named = (F.col("canonical") != "") & (F.col("canonical") != needs_zip)
    source = (
        F.when(~has_city, None).when(F.col("canonical") == "", "excluded").when(named, "name_map").when(F.col("found_zip").isNotNull(), "zip")
        .when((F.col("address_line1") != "") & F.col("assigned").isNotNull(), "address_map").otherwise("unresolved")
    )
    city = F.when(F.col("city_norm_source") == "name_map", F.col("canonical")).when(F.col("city_norm_source") == "zip", F.try_element_at(areas, F.col("found_zip"))).when(F.col("city_norm_source") == "address_map", F.col("assigned"))
    return j.withColumn("city_norm_source", source).withColumn("city_normalized", city).select(*jobs.columns, "city_normalized", "city_norm_source")


def known_zip(text: Column, zip_areas: dict[str, str], zip_typos: dict[str, str]) -> Column:
    return clean_zip(text, map_of(zip_areas), map_of(zip_typos))


def known_pairs(pairs: DataFrame, activities: DataFrame, most_unknown: float = 0.01) -> DataFrame:
    """Pairs of known activities; an error if more than ``most_unknown`` of the activities named are unknown."""
    named = pairs.select("activity_id").distinct().join(activities.select("activity_id", F.lit(1).alias("known")), "activity_id", "left")
    n, known = named.agg(F.count("*"), F.count("known")).first()
    if n - known > most_unknown * n:
        raise ValueError(f"{n - known} of {n} activities are unknown")
    return pairs.join(activities.select("activity_id"), "activity_id", "left_semi")
