"""A corpus pipeline: language, exact copies, near copies, benchmark passages, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads it again for the next.
All but the last return the columns of documents. Nulls, empty texts and empty tables are as each operator defines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm import decontaminate, exact_dedup, language_id, mixing, ngram_join
from skein.llm.common import NO_ID, packed, stash
from skein.sources.tables import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; those without a letter go."""
    found = language_id.identify(docs, language_id.learned(docs), carry=True)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.exact_dedup(docs).where("kept").select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group that similarity links."""
    found = ngram_join.ngram_join(docs).where("first").select(F.col("doc_id").alias("i"), F.col("th").alias("t")).distinct()
    row_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    keyed = packed(docs).select("row", row_id.alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    nth = F.row_number().over(Window.partitionBy("i", "t").orderBy("i"))
    return keyed.join(found, ["i", "t"]).withColumn("nth", nth).where("nth = 1").select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in benchmark windows."""
    found = decontaminate.contamination(decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark")))
    return found.where(~F.col("contaminated")).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the copies that the mix takes of each (0 to 2) and the words in them; columns of these names give way."""
    new = ("size", "source_size", "target", "copies", "taken")
    return mixing.mix(docs).select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in new], *new)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("ngram_join", without_near_copies),
    ("decontaminate", without_benchmark),
    ("mix_sources", mixed),
]

#: Languages are predicted by a trained model and near copies found over all pairs, so no SQL states the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of what all stages keep of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
