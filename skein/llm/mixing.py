"""Mixing sources to target weights by Pareto order sampling.

A document's expected number of copies is its weight times a rate of its source, at most MOST_COPIES; the rate is that with
which the source's words make its target. The whole part is certain. The rest is its inclusion probability p, and documents are
ranked by u / (1 - u) over p / (1 - p) with u drawn from a hash of the id, so a rerun agrees. Documents of the lowest ranks are
taken until the source's words are nearest to its target. Ranks are cut by histograms first, one within a bin of the other:
only the last bin in which a source's limit falls is sorted, so no source, however large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import packed, stash
from skein.sources.tables import table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0
#: Bins of a histogram of ranks, and how many histograms there are, each within one bin of the one before.
BINS, LEVELS = 64, 4
#: Weights count to so many digits after their first, so that a source has a bounded number of different ones (9,000 in each power of ten).
DIGITS = 3


def words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size and target from (source, source_size): one row for each source, so small.

    Sources by code point, null last, get the weights in turn. Sources reach their limit (most times their size) in the
    order of limit over weight; a source is at its limit if the words left then would give it no less.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(most)
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.partitionBy(F.lit(0)).orderBy(limit / F.col("w"), F.col("source").asc_nulls_last())
    whole, before = Window.partitionBy(F.lit(0)), by_limit.rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("nth", F.row_number().over(by_name) - 1).withColumn("w", w)
    s = s.withColumns(
        {
            "left": F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum(limit).over(before), F.lit(0.0)),
            "open": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        }
    )
    s = s.withColumn("full", F.col("left") * F.col("w") >= limit * F.col("open"))
    first_open = F.when(~F.col("full"), F.struct((limit / F.col("w")).alias("a"), F.col("nth").alias("b")))
    s = s.withColumn("rate", F.min_by(F.col("left") / F.col("open"), first_open).over(whole))
    return s.select("source", "source_size", F.when(F.col("full"), limit).otherwise(F.col("w") * F.col("rate")).alias("target"))


def draw(doc_id, seed: int):
    """A number in (0, 1) from the id alone."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    return (h + 0.5) / F.lit(float(1 << 52))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = 7, weight_col: str | None = None) -> DataFrame:
    """One row for each row of docs: row, doc_id, size, source_size, target, copies and taken (copies times size).

    With weight_col, a finite number of at least 0 (null as 1; others raise an error), the expected copies of a document are
    proportional to it within its source, up to ``most`` copies; only how weights of a source compare counts, not how large they are,
    and of a weight its first four digits. Documents without words (null, empty) are taken 0 times; a null source is a
    source of its own; rows repeated with one id share their draw and are cut in any order among themselves. An empty table
    gives an empty result.
    """
    rows = packed(docs, id_col, text_col).select(
        "row", "doc_id", F.col(f"row.`{source_col}`").alias("source"), words(F.col("text")).alias("size"),
        (F.lit(1.0) if weight_col is None else F.col(f"row.`{weight_col}`").cast("double")).alias("tilt"),
    )
    return allocate(stash(rows, "mix"), weights, share, most, seed)


def rates(classes: DataFrame, goal: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """goal (source, source_size, target) with rate, from the words of each weight of a source (source, tilt, words).

    Weights from the largest down are at the limit of ``most`` copies as long as the words then left give them no less; the rate
    is what is left over what is open. It is null where all are at the limit.
    """
    c = classes.where("tilt > 0").join(goal.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g"))).drop("g")
    of = Window.partitionBy("source")
    down, up = of.orderBy(F.desc("tilt")), of.orderBy("tilt")
    over = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumns({"left": F.col("target") - F.lit(most) * over, "open": F.sum(F.col("words") * F.col("tilt")).over(up.rowsBetween(Window.unboundedPreceding, 0))})
    c = c.withColumn("full", F.col("left") * F.col("tilt") >= F.lit(most) * F.col("open"))
    found = c.groupBy(F.col("source").alias("g")).agg(F.max_by(F.try_divide("left", "open"), F.when(~F.col("full"), F.col("tilt"))).alias("rate"))
    return goal.join(found, F.col("source").eqNullSafe(F.col("g")), "left").drop("g")


def allocate(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = 7) -> DataFrame:
    """rows (doc_id, source, size, tilt, perhaps row), which are read several times, with source_size, target, copies and taken."""
    tilt = F.coalesce("tilt", F.lit(1.0))
    fine = (tilt >= 0) & (tilt < float("inf"))  # NaN is greater than all numbers
    rows = rows.withColumn("tilt", F.when(fine, F.format_string(f"%.{DIGITS}e", tilt).cast("double")).otherwise(F.raise_error(F.lit("a weight must be a finite number of at least 0"))))
    classes = stash(rows.groupBy("source", "tilt").agg(F.sum("size").alias("words")), "sources")
    goal = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    goal = stash(rates(classes, goal, most).withColumnRenamed("source", "g"), "targets")
    r = rows.join(goal, F.col("source").eqNullSafe(F.col("g"))).drop("g")
    expected = F.least(F.lit(float(most)), F.coalesce(F.col("rate") * F.col("tilt"), F.lit(float(most))))
    r = r.withColumn("expected", F.when((F.col("size") > 0) & (F.col("tilt") > 0), expected).otherwise(0.0))
    r = r.withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.col("whole"))
    u = draw(F.col("doc_id"), seed)
    q = F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    r = r.withColumn("q", q).withColumn("x", F.col("q") / (1 + F.col("q")))
    need = r.groupBy(F.col("source").alias("g")).agg((F.first("target") - F.sum(F.col("size") * F.col("whole"))).alias("need"))
    # the bin of each source in which its limit falls (null: all are taken), and the words before it
    edge = stash(need.select("g", "need", F.lit(0.0).alias("before"), F.lit(0).cast("long").alias("edge")), "edge")
    bin_of = lambda level: F.floor(F.col("x") * F.lit(float(BINS**level)))
    drawn = r.where("x is not null").select("source", "size", "x")
    for level in range(1, LEVELS + 1):
        inside = drawn.join(edge, F.col("source").eqNullSafe(F.col("g")) & (bin_of(level - 1) == F.col("edge")))
        bins = inside.groupBy("g", bin_of(level).alias("bin")).agg(F.sum("size").alias("words"), F.first("need").alias("need"), F.first("before").alias("before"))
        upto = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("reach", F.col("before") + F.sum("words").over(upto)).where("reach > need")
        edge = stash(bins.groupBy("g").agg(F.first("need").alias("need"), F.min_by(F.col("reach") - F.col("words"), "bin").alias("before"), F.min("bin").alias("edge")), "edge")
    r = r.join(edge, F.col("source").eqNullSafe(F.col("g")), "left").withColumn("bin", bin_of(LEVELS))
    at_edge = F.coalesce(F.col("bin") == F.col("edge"), F.lit(False))
    at = Window.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = r.where(at_edge).withColumn("until", F.col("before") + F.sum("size").over(at))
    # the last document is taken if the sum then comes nearer to what is needed
    inside = inside.withColumn("extra", (F.col("until") - F.col("size") / 2 <= F.col("need")).cast("long")).drop("until")
    rest = r.where(~at_edge).withColumn("extra", (F.col("x").isNotNull() & (F.col("edge").isNull() | (F.col("bin") < F.col("edge")))).cast("long"))
    out = inside.unionByName(rest).withColumn("copies", F.col("whole") + F.col("extra"))
    return out.select(*[c for c in ("row",) if c in rows.columns], "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer documents weigh more: as many as their size has digits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    rows = stash(docs.withColumn("tilt", F.length(F.col("size").cast("string")).cast("double")), "sizes")
    return allocate(rows).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source
), w AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS top FROM s
), l AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(top) OVER o, 0) AS remaining, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open
  FROM w WINDOW o AS (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, remaining * w >= top * open AS is_full, row_number() OVER (ORDER BY top / w, source NULLS LAST) AS place FROM l
), g AS (
  SELECT source, source_size, CASE WHEN is_full THEN top ELSE w * min_by(remaining / open, place) FILTER (WHERE NOT is_full) OVER () END AS target FROM f
), c AS (
  SELECT source, CAST(length(CAST(size AS VARCHAR)) AS DOUBLE) AS tilt, sum(size) AS words FROM d GROUP BY ALL
), h AS (
  SELECT c.source, tilt, target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY tilt DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(words * tilt) OVER (PARTITION BY c.source ORDER BY tilt ROWS UNBOUNDED PRECEDING) AS open FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source
), k AS (
  SELECT source, max_by(remaining / open, tilt) FILTER (WHERE remaining * tilt < 2.0::DOUBLE * open) AS rate FROM h GROUP BY source
), e AS (
  SELECT d.doc_id, d.source, size, source_size, target, CASE WHEN size > 0 THEN least(2.0::DOUBLE, coalesce(rate * CAST(length(CAST(size AS VARCHAR)) AS DOUBLE), 2.0::DOUBLE)) ELSE 0 END AS expected,
         (CAST(('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN k ON d.source IS NOT DISTINCT FROM k.source
), q AS (
  SELECT *, floor(expected) AS whole, CASE WHEN expected > floor(expected) THEN (u / (1 - u)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) END AS q FROM e
), r AS (
  SELECT *, target - sum(size * whole) OVER (PARTITION BY source) AS need,
         sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS FIRST, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS until FROM q
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN q IS NOT NULL AND until - size / 2 <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
