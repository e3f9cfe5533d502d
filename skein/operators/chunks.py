"""Searchable chunks: facts about the record, notes from three sources, hashes, and the queues of what is to be done anew."""

from __future__ import annotations

import decimal
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.parsers import joined, long_enough, said, text_hash, token_estimate
from skein.operators.ordering import running

#: Phrases of notes that programs wrote.
BOT_PHRASES = ("payment bot", "backfill", "check-bot", "Payment recorded", "Payment received", "No movement in the job since", "invoice-parsing fix")


def is_bot(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(BOT_PHRASES)), F.lit(False))


def job_materials(areas: DataFrame) -> DataFrame:
    """materials (distinct, not blank, in order; null if none) and n_areas of each job."""
    names = F.array_join(F.sort_array(F.collect_set(F.when(F.col("material_name") != "", F.col("material_name")))), ", ")
    return areas.groupBy("job_id").agg(F.nullif(names, F.lit("")).alias("materials"), F.count("*").alias("n_areas"))


def job_facts(jobs: DataFrame, areas: DataFrame) -> DataFrame:
    """job_id, job_facts (one line of what is known) and n_areas."""
    return facts_of(jobs, job_materials(areas))


def facts_of(jobs: DataFrame, materials: DataFrame) -> DataFrame:
    """job_facts() from job_materials(), which may have been written."""
    j, c = jobs.join(materials, "job_id", "left"), F.col
    account = F.when(c("account_name") != F.coalesce(c("job_name"), F.lit("")), c("account_name"))
    name = F.coalesce(said('Job "', c("job_name"), '"'), F.concat(F.lit("Job "), c("job_id").cast("string")))
    facts = joined(
        name, said("in ", c("city_normalized")), said("salesperson ", c("salesperson")), said("account ", account), said("process ", c("process_name")),
        said("status ", c("job_status_name")), said("materials on this job: ", c("materials")),
    )
    return j.select("job_id", facts.alias("job_facts"), F.coalesce("n_areas", F.lit(0)).alias("n_areas"))


def activity_notes(activities: DataFrame) -> DataFrame:
    """Notes with what is known of them beside their job (about), and that if the job has one area (about_single; null: the same)."""
    rows, c = activities.where(long_enough(F.col("notes"))), F.col
    about = joined(
        F.coalesce(said("this note is on a ", c("type_name"), " activity"), F.lit("this note is on an activity")), said("activity status ", c("status_name")),
        F.coalesce(said("dated ", c("activity_date")), F.lit("undated")), said("phase ", c("phase")) if "phase" in activities.columns else F.lit(None).cast("string"),
    )
    return rows.select(F.lit("activity_note").alias("source_type"), F.col("activity_id").alias("source_id"), "job_id", F.col("notes").alias("raw_text"), about.alias("about"), F.lit(None).cast("string").alias("about_single"))


def area_notes(areas: DataFrame) -> DataFrame:
    rows, c = areas.where(long_enough(F.col("notes"))), F.col
    single = F.concat(F.lit("this note is on the job's single area"), F.coalesce(said(" (room type: ", c("room_type"), ")"), F.lit("")))
    named, many = said('this note is on the "', c("area_name"), '" area'), F.lit("this note is on one of the job's areas")
    room = F.when(c("area_name") != "", said("room type ", c("room_type")))
    about = lambda where: joined(where, room, said("", c("sq_ft_raw"), " sq ft"), said("area material ", c("material_name")), said("supplier ", c("supplier")))
    return rows.select(F.lit("area_note").alias("source_type"), F.col("form_id").alias("source_id"), "job_id", F.col("notes").alias("raw_text"), about(F.coalesce(named, many)).alias("about"), F.when(named.isNull(), about(single)).alias("about_single"))


def summary_notes(forms: DataFrame, fields: DataFrame) -> DataFrame:
    summary = forms.where(F.col("form_template_name") == "Job Summary").select("form_id", "job_id")
    notes = fields.where((F.col("field_name") == "Notes") & long_enough(F.col("field_value"))).select("form_id", "field_value")
    about = F.lit("this note is the job's summary-form notes")
    return summary.join(notes, "form_id").select(F.lit("area_note").alias("source_type"), F.col("form_id").alias("source_id"), "job_id", F.col("field_value").alias("raw_text"), about.alias("about"), F.lit(None).cast("string").alias("about_single"))


def with_facts(notes: DataFrame, facts: DataFrame) -> DataFrame:
    """Notes (of one source or several) of known jobs as chunks, with the facts of their jobs by one join."""
    about = F.when(F.col("n_areas") == 1, F.coalesce("about_single", "about")).otherwise(F.col("about"))
    return notes.join(facts, "job_id").select("source_type", "source_id", "job_id", "raw_text", joined(F.col("job_facts"), about).alias("facts"))


def activity_chunks(activities: DataFrame, facts: DataFrame) -> DataFrame:
    return with_facts(activity_notes(activities), facts)


def notes_of(activities: DataFrame, areas: DataFrame, forms: DataFrame, fields: DataFrame) -> DataFrame:
    """The notes of all three sources."""
    return activity_notes(activities).unionByName(area_notes(areas)).unionByName(summary_notes(forms, fields))


def finished(chunks: DataFrame) -> DataFrame:
    """Chunks with their hash, token estimate and bot flag."""
    return chunks.withColumns({"text_hash": text_hash(F.col("raw_text"), F.col("facts")), "token_count": token_estimate(F.col("raw_text")), "is_bot_generated": is_bot(F.col("raw_text"))})


def build_chunks(jobs: DataFrame, activities: DataFrame, areas: DataFrame, forms: DataFrame, fields: DataFrame) -> DataFrame:
    return finished(with_facts(notes_of(activities, areas, forms, fields), job_facts(jobs, areas)))


def merge_chunks(old: DataFrame, new: DataFrame, keys: tuple = ("source_type", "source_id")) -> DataFrame:
    """``new`` with the context_text of ``old`` where the hash is the same, else null: the queue of what to enrich.

    Chunks that are no longer built go.
    """
    kept = old.select(*keys, F.col("text_hash").alias("old_hash"), F.col("context_text").alias("old_context"))
    same = F.col("old_hash") == F.col("text_hash")
    return new.join(kept, list(keys), "left").withColumn("context_text", F.when(same, F.col("old_context"))).drop("old_hash", "old_context")


def enrich(chunks: DataFrame, write: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Fills context_text where it is null; by default with the facts as a sentence."""
    made = write(F.col("facts"), F.col("raw_text")) if write else F.concat(F.col("facts"), F.lit("."))
    return chunks.withColumn("context_text", F.coalesce("context_text", made))


def stale(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks without a vector or whose vector was made from another text."""
    have = vectors.select(key, F.col("text_hash").alias("vector_hash"))
    return chunks.join(have, key, "left").where(~F.col("vector_hash").eqNullSafe(F.col("text_hash"))).drop("vector_hash")


def projected_cost(chunks: DataFrame, prompt_tokens: int, in_price: float, out_price: float, out_tokens: int = 80, by: tuple = ()) -> DataFrame:
    """requests and projected (in money) of enriching these chunks, before anything is asked for.

    A request has the prompt, ten tokens around it, and a token for every four characters of facts and text; prices are for a million tokens.
    """
    tokens = F.lit(prompt_tokens + 10) + F.floor((F.length("facts") + F.length("raw_text")) / 4)
    cost = (F.sum(tokens) * F.lit(float(in_price)) + F.count("*") * F.lit(out_tokens * float(out_price))) / F.lit(1e6)
    return chunks.groupBy(*by).agg(F.count("*").alias("requests"), cost.alias("projected"))


def within_ceiling(chunks: DataFrame, spent: float, ceiling: float, prompt_tokens: int, in_price: float, out_price: float) -> float:
    """The projected cost; an error, before anything is asked for, if it and what was spent exceed the ceiling."""
    projected = projected_cost(chunks, prompt_tokens, in_price, out_price).first()["projected"] or 0.0
    if spent + projected > ceiling:
        raise ValueError(f"{spent:.2f} spent and {projected:.2f} projected exceed {ceiling:.2f}")
    return projected


#: Requests that are sent at a time.
REQUESTS = 2000


def request_batches(chunks: DataFrame, prompt_tokens: int, in_price: float, out_price: float, out_tokens: int = 80, ceiling: float | None = None, spent: float = 0.0, most: int = REQUESTS, order: tuple = ("source_type", "source_id")) -> DataFrame:
    """``chunks`` (facts, raw_text and the columns of ``order``, which tell them apart) with request (from 0), batch (of at most ``most`` requests), cost and running (the cost up to this one and what was spent).

    Costs are as projected_cost has them, in money as decimals; a request whose running cost is over the ``ceiling`` is not in the
    result, nor is any after it, so the batches can be sent one by one without passing it.
    """
    tokens = F.lit(prompt_tokens + 10) + F.floor((F.length("facts") + F.length("raw_text")) / 4)
    price = lambda p: F.lit(decimal.Decimal(str(p))).cast("decimal(18,6)")
    # sums of whole numbers of millionths, which do not depend on where rows are
    cost = tokens.cast("decimal(12,0)") * price(in_price) + F.lit(out_tokens).cast("decimal(12,0)") * price(out_price)
    rows = running(chunks.withColumn("cost", cost.cast("decimal(24,6)")), list(order), {"request": F.lit(1).cast("long"), "running": F.col("cost")})
    money = lambda c: (c.cast("decimal(24,6)") * F.lit(decimal.Decimal("0.000001"))).cast("decimal(30,12)")
    amount = lambda x: F.lit(decimal.Decimal(str(x))).cast("decimal(30,12)")
    rows = rows.withColumns({"request": F.col("request") - 1, "cost": money(F.col("cost")), "running": (money(F.col("running")) + amount(spent)).cast("decimal(30,12)")})
    rows = rows.withColumn("batch", F.expr(f"request div {int(most)}"))
    return rows if ceiling is None else rows.where(F.col("running") <= amount(ceiling))


def patient(ask: Callable, refused: type[Exception] = ConnectionError, most: float = 3600.0, delay: float = 10.0, longest: float = 300.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``ask`` that waits and asks again when refused: twice as long each time, between half and one and a half of that by chance, for ``most`` seconds in all."""

    def asked(*args):
        pause, waited = delay, 0.0
        while True:
            try:
                return ask(*args)
            except refused:
                if waited >= most:
                    raise
            now = pause * random.uniform(0.5, 1.5)
            sleep(now)
            waited, pause = waited + now, min(2 * pause, longest)

    return asked


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], key: str = "chunk_id", batch: int = 48) -> DataFrame:
    """(key, embedding, text_hash) by an injected embedder, asked with ``batch`` texts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key], "embedding": embedder(part["text"].tolist()), "text_hash": part["text_hash"]})

    rows = chunks.select(key, F.concat_ws("\n", "context_text", "raw_text").alias("text"), "text_hash")
    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<float>, text_hash string")
