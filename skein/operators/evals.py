"""Evaluation: ranking metrics, confusion matrix, correctness by route, regression gates. Many queries and lanes in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.parsers import numeric_match

ROUTES = ("structured", "semantic", "hybrid", "refuse")
CUTS = (5, 10, 20)


def ranking_metrics(ranks: DataFrame, gold: DataFrame, by: tuple = ("lane",), cuts: tuple = CUTS, k: int = 10, asked: DataFrame | None = None) -> DataFrame:
    """recall_at_<cut>, mrr and ndcg of each lane and query: ``ranks`` (lane, query_id, chunk_id, rank) against ``gold`` (query_id, chunk_id).

    ``asked`` has a row (lane, query_id) for each list there should be; one that found nothing scores 0. By default these are the
    lists of ``ranks`` and the queries with gold in each of its lanes. Queries without gold have null recall and NDCG and an MRR of 0.
    """
    truth = gold.select("query_id", "chunk_id").distinct()
    rows = ranks.join(truth.withColumn("hit", F.lit(True)), ["query_id", "chunk_id"], "left")
    sizes = truth.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    if asked is None:
        lanes = F.explode(ranks.agg(F.collect_set(F.struct(*by))).scalar()).alias("l")  # the few lanes that are compared
        asked = ranks.select(*by, "query_id").union(sizes.select(lanes, "query_id").select("l.*", "query_id"))
    return metrics_of(rows, sizes, asked, by, cuts, k)


def metrics_of(rows: DataFrame, sizes: DataFrame, asked: DataFrame, by: tuple = ("lane",), cuts: tuple = CUTS, k: int = 10) -> DataFrame:
    """The same from ranked rows (lane, query_id, rank, hit) and the number of gold chunks (query_id, n_gold)."""
    hit, rank = F.coalesce("hit", F.lit(False)), F.col("rank")
    gain = F.sum(F.when(hit & (rank <= k), 1 / F.log2(rank + F.lit(1.0))))
    got = rows.groupBy(*by, "query_id").agg(*[F.count_if(hit & (rank <= c)).alias(f"_{c}") for c in cuts], F.min(F.when(hit, rank)).alias("first"), gain.alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    out = asked.select(*by, "query_id").distinct().join(got, [*by, "query_id"], "left").na.fill(0, [f"_{c}" for c in cuts]).join(sizes, "query_id", "left")
    recalls = [F.round(F.col(f"_{c}") / F.col("n_gold"), 9).alias(f"recall_at_{c}") for c in cuts]
    ndcg = F.when(F.col("n_gold") > 0, F.round(F.coalesce("gain", F.lit(0.0)) / ideal, 9))
    return out.select(*by, "query_id", *recalls, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 9).alias("mrr"), ndcg.alias("ndcg"))


def markdown_lines(rows: DataFrame, labels: list[str], numbers: list[str], digits: int = 3) -> DataFrame:
    """Each row as a line of a Markdown table, numbers with so many digits and a dash for none."""
    number = lambda c: F.coalesce(F.format_string(f"%.{digits}f", F.round(F.col(c), digits)), F.lit("—"))
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *labels, *[F.when(F.col(c).isNull(), "—").otherwise(number(c)) for c in numbers]), F.lit(" |")).alias("line"))


def means(metrics: DataFrame, by: tuple = ("lane",)) -> DataFrame:
    """The mean of each metric, nulls left out."""
    names = [c for c in metrics.columns if c not in (*by, "query_id")]
    return metrics.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def confusion_matrix(pairs: DataFrame, routes: tuple = ROUTES) -> DataFrame:
    """One row for each expected route with a count for each predicted one; anything else counts as refuse."""
    known = lambda c: F.when(F.col(c).isin(*routes), F.col(c)).otherwise("refuse")
    rows = pairs.select(known("expected").alias("expected"), known("predicted").alias("predicted"))
    names = rows.sparkSession.createDataFrame([(r,) for r in routes], "expected string")
    counts = rows.groupBy("expected").agg(*[F.count_if(F.col("predicted") == r).alias(f"as_{r}") for r in routes])
    return names.join(counts, "expected", "left").na.fill(0)


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.round(F.avg((F.col("expected") == F.col("predicted")).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


def correct(expected_route: Column, predicted_route: Column, expected: Column, answer: Column, judged: Column) -> Column:
    """Whether an answer is right: a refusal by its route, a structured one by its numbers or else the judge, others by the judge."""
    by_number = numeric_match(expected, answer)
    return F.when(expected_route == "refuse", predicted_route == "refuse").when(expected_route == "structured", F.coalesce(by_number, judged)).otherwise(judged)


def context_precision(useful: Column, retrieved: Column) -> Column:
    """The share of what was retrieved that was useful; null if nothing was."""
    return F.try_divide(F.size(F.array_intersect(useful, retrieved)).cast("double"), F.size(F.array_distinct(retrieved)))


def model_runs(questions: DataFrame, models: dict[str, Callable[[list[str]], list[tuple[str, float, float]]]], batch: int = 48) -> DataFrame:
    """A row for each injected model and question (query_id, question, expected): model, query_id, answer, correct, seconds, cost.

    A model is asked for ``batch`` questions at a time and gives answer, seconds and cost of each. Answers are judged by their numbers;
    correct is null where the expected answer has none. Each model runs over the questions in tasks of its own.
    """

    def asked(name: str, ask: Callable) -> DataFrame:
        def run(frames):
            for f in frames:
                for at in range(0, len(f), batch):
                    part = f.iloc[at : at + batch]
                    found = ask(part["question"].fillna("").tolist())
                    yield part[["query_id", "expected"]].assign(answer=[a for a, _, _ in found], seconds=[float(s) for _, s, _ in found], cost=[float(c) for _, _, c in found])

        kind = questions.schema["query_id"].dataType.simpleString()
        rows = questions.select("query_id", "question", "expected").mapInPandas(run, f"query_id {kind}, expected string, answer string, seconds double, cost double")
        return rows.withColumn("model", F.lit(name))

    out = None
    for name, ask in models.items():
        one = asked(name, ask)
        out = one if out is None else out.unionByName(one)
    return out.select("model", "query_id", "answer", numeric_match(F.col("expected"), F.col("answer")).alias("correct"), "seconds", "cost")


def cost_summary(runs: DataFrame) -> DataFrame:
    """accuracy, mean seconds and cost for each right answer by model: ``runs`` (model, correct, seconds, cost)."""
    right = F.count_if("correct")
    return runs.groupBy("model").agg(F.count("*").alias("n"), right.alias("n_correct"), F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.round(F.sum("cost"), 9).alias("cost"), F.round(F.try_divide(F.sum("cost"), right), 9).alias("cost_per_correct"))


def regressions(current: DataFrame, baseline: DataFrame, slack: float = 0.05) -> DataFrame:
    """The metrics (metric, value) that fell by more than ``slack``, or are missing now."""
    b = baseline.select("metric", F.col("value").alias("was"))
    return b.join(current.select("metric", "value"), "metric", "left").where(F.col("value").isNull() | (F.col("value") < F.col("was") - slack))


def failure_report(rows: DataFrame) -> DataFrame:
    """New failures among verified questions, and questions known to fail that pass: ``rows`` (id, status, correct)."""
    kind = F.when((F.col("status") == "verified") & ~F.col("correct"), "new failure").when((F.col("status") == "FAILING") & F.col("correct"), "now passes")
    return rows.withColumn("report", kind).where(F.col("report").isNotNull())


def first_questions(golden: DataFrame, n: int | None) -> DataFrame:
    """The first n questions by id, for a short run; all without n."""
    return golden if n is None else golden.orderBy("id").limit(n)


def draw(keys: list[str], seed: int = 0) -> Column:
    """A number in (0, 1] from the keys of a row and a seed alone: the first 52 bits of a digest."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))


def sample(rows: DataFrame, n: int, seed: int = 0, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """n rows picked by chance, the same ones for a seed however the rows are partitioned; for small n, as they pass through the driver's merge.

    Each row draws from its ``keys`` (all columns by default, which must tell rows apart); the n smallest draws stay, so samples of
    parts merge into that of the whole by the same rule (merged). With ``weight``, a column of numbers, a row is picked in proportion
    to it: the draw is an exponential one over the weight; rows of no, null or negative weight are never picked.
    """
    keys = keys or rows.columns
    u = draw(keys, seed)
    if weight is None:
        return rows.orderBy(u, *keys).limit(n)
    w = F.col(weight).cast("double")
    return rows.where((w > 0) & ~F.isnan(w)).orderBy(-F.ln(u) / w, *keys).limit(n)


def merged(samples: list[DataFrame], n: int, seed: int = 0, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """The sample of all from samples of disjoint parts that were taken with the same n or more, seed, keys and weight."""
    out = samples[0]
    for s in samples[1:]:
        out = out.unionByName(s)
    return sample(out, n, seed, keys, weight)


def read_golden(rows: DataFrame) -> DataFrame:
    """Golden questions with relevant_ids ('1, 2, 3') as array<bigint>; retired ones are left out."""
    ids = F.filter(F.transform(F.split(F.coalesce("relevant_ids", F.lit("")), ","), lambda x: F.btrim(x).try_cast("bigint")), lambda x: x.isNotNull())
    return rows.where(F.col("status").isin("verified", "draft", "FAILING")).withColumn("relevant_ids", ids)
