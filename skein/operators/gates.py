"""Data-quality gates: each returns rows (gate, value, expected, ok)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _gate(df: DataFrame, name: str, value: Column, expected: Column, ok: Column | None = None) -> DataFrame:
    row = df.agg(value.cast("double").alias("value")).withColumn("expected", expected.cast("double"))
    return row.select(F.lit(name).alias("gate"), "value", "expected", (F.col("value") == F.col("expected") if ok is None else ok).alias("ok"))


def union(gates: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)


def row_count(df: DataFrame, name: str, expected: int, slack: int = 0) -> DataFrame:
    return _gate(df, name, F.count("*"), F.lit(expected), F.abs(F.col("value") - F.col("expected")) <= slack)


def no_orphans(child: DataFrame, parent: DataFrame, key: str, name: str, share: float = 0.0) -> DataFrame:
    """Rows of child without a parent; at most ``share`` of child's rows."""
    known = parent.select(key, F.lit(1).alias("known")).distinct()
    rows = child.select(key).join(known, key, "left")
    counts = rows.agg(F.count_if(F.col("known").isNull()).cast("double").alias("value"), F.count("*").alias("n"))
    return counts.select(F.lit(name).alias("gate"), "value", F.lit(0.0).alias("expected"), (F.col("value") <= F.col("n") * share).alias("ok"))


def unique_key(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return _gate(df.groupBy(*keys).count().where("count > 1"), name, F.count("*"), F.lit(0))


def vector_length(vectors: DataFrame, length: int, name: str = "vector length") -> DataFrame:
    return _gate(vectors, name, F.count_if(F.coalesce(F.size("embedding") != length, F.lit(True))), F.lit(0))


def coverage(done: Column, df: DataFrame, name: str) -> DataFrame:
    """Rows for which ``done`` does not hold."""
    return _gate(df, name, F.count_if(~F.coalesce(done, F.lit(False))), F.lit(0))


def parts_sum_up(parts: DataFrame, count: str, total: DataFrame, name: str) -> DataFrame:
    """Whether the parts' counts make the total's number of rows."""
    row = parts.agg(F.sum(count).cast("double").alias("value")).withColumn("expected", total.agg(F.count("*").cast("double")).scalar())
    return row.select(F.lit(name).alias("gate"), "value", "expected", (F.col("value") == F.col("expected")).alias("ok"))


def group_counts(df: DataFrame, key: str, expected: DataFrame, each: int = 2, total: int = 5) -> DataFrame:
    """Counts of each group within ``each`` of those expected (key, n), and of all within ``total``."""
    got = df.groupBy(key).agg(F.count("*").alias("value"))
    rows = expected.select(key, F.col("n").alias("expected")).join(got, key, "full").na.fill(0, ["value", "expected"])
    per = rows.select(F.concat(F.lit(f"{key} "), F.coalesce(key, F.lit("(none)"))).alias("gate"), F.col("value").cast("double").alias("value"), F.col("expected").cast("double").alias("expected"), (F.abs(F.col("value") - F.col("expected")) <= each).alias("ok"))
    sums = rows.agg(F.sum("value").cast("double").alias("value"), F.sum("expected").cast("double").alias("expected")).select(F.lit(f"{key} total").alias("gate"), "value", "expected", (F.abs(F.col("value") - F.col("expected")) <= total).alias("ok"))
    return per.unionByName(sums)


def spend(journal: DataFrame, ceiling: float) -> DataFrame:
    """Money spent as the journal's notes tell it (cost_usd=...), against a ceiling."""
    cost = F.regexp_extract("note", r"cost_usd=([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return _gate(journal.where(F.col("note").like("%cost_usd=%")), "spend", F.coalesce(F.sum(cost), F.lit(0.0)), F.lit(ceiling), F.col("value") <= F.col("expected"))


def failed(gates: DataFrame) -> DataFrame:
    return gates.where(~F.coalesce("ok", F.lit(False)))


def probe(spark: SparkSession, names: Iterable[str]) -> list[tuple[str, bool, int | None, int | None]]:
    """name, whether the session has such a table or view that can be read, its columns and rows."""
    out = []
    for name in names:
        if not spark.catalog.tableExists(name):
            out.append((name, False, None, None))
            continue
        rows = spark.table(name)
        out.append((name, True, len(rows.columns), rows.count()))
    return out
