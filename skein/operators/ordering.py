"""Row numbers and running sums over a whole table without a task that sees all rows.

Rows are dealt by range of their order, so that no partition is larger than others however the values are spread; a partition's
sums go before the next one's, and only these sums, one row for each partition, are put in order in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.sources.tables import kept


def running(rows: DataFrame, order: list[str], sums: dict[str, str | Column]) -> DataFrame:
    """``rows`` with a column for each of ``sums``: the sum of its value over the rows up to this one in ``order``, itself included.

    ``order`` names columns that tell all rows apart (nulls first); rows that tie are numbered in any order. Values are whole numbers
    or decimals, so that a sum does not depend on where rows are; a null counts as nothing.
    """
    names = {f"_v{i}": F.expr(v) if isinstance(v, str) else v for i, v in enumerate(sums.values())}
    dealt = rows.withColumns(names).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = kept(dealt, "ordered")  # a partition's number must be the same for its rows and its sums
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(*[F.sum(v).alias(v) for v in names])
    before = F.broadcast(totals.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(v).over(whole), F.lit(0)).alias(f"_before{v}") for v in names]))  # a row for each partition
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(before, F.col("_part") == F.col("_p"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[(F.coalesce(F.sum(v).over(here), F.lit(0)) + F.col(f"_before{v}")).alias(name) for v, name in zip(names, sums, strict=True)])


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with their number from 0 in ``order``, which tells them apart."""
    return running(rows, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)
