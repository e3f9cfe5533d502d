"""From a question to evidence: route, structured lane, retrieval, evidence text. Models are injected; the defaults are rules."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators import blocks, clusters, retrieval
from skein.operators.blocks import BlockIndex
from skein.operators.clusters import ClusterIndex
from skein.plans.guard import Guard, Rejected, Result, run_structured
from skein.sources.tables import kept

ROUTES = ("structured", "semantic", "hybrid", "refuse")
SHOWN = 50
REFUSAL = "This question cannot be answered from the job records."
_COUNTING = re.compile(r"\b(how many|how much|total|average|count|top|most|least|percent|rate|revenue|which (month|year)|list)\b", re.I)
_TEXTUAL = re.compile(r"\b(notes?|mention\w*|said|say|complain\w*|describe\w*|why|problem\w*|issue\w*|about)\b", re.I)


@dataclass(frozen=True)
class Route:
    route: str
    reason: str


def rule_router(question: str) -> Route:
    """The default: questions for numbers are structured, for notes semantic, for both hybrid; no words are refused."""
    if not re.search(r"\w", question or ""):
        return Route("refuse", "no words")
    number, text = bool(_COUNTING.search(question)), bool(_TEXTUAL.search(question))
    return Route("hybrid" if number and text else "structured" if number else "semantic", "rules")


def route(question: str, router: Callable[[str], Route] = rule_router) -> Route:
    """The router's choice; what it cannot say, or says outside the four routes, is semantic."""
    try:
        found = router(question)
    except ValueError as e:
        return Route("semantic", f"router failed: {e}")
    return found if found.route in ROUTES else Route("semantic", f"unknown route {found.route}")


def routes(questions: DataFrame, router: Callable[[str], Route] = rule_router) -> DataFrame:
    """``questions`` (question and others) with route and reason; the rules are columns, another router is asked question by question."""
    if router is rule_router:
        asked = F.coalesce("question", F.lit(""))
        number, text = (asked.rlike(f"(?iU){rule.pattern}") for rule in (_COUNTING, _TEXTUAL))
        said = asked.rlike(r"(?U)\w")
        chosen = F.when(~said, "refuse").when(number & text, "hybrid").when(number, "structured").otherwise("semantic")
        return questions.withColumns({"route": chosen, "reason": F.when(said, "rules").otherwise("no words")})

    def run(frames):
        for f in frames:
            found = [route(q, router) for q in f["question"]]
            yield f.assign(route=[r.route for r in found], reason=[r.reason for r in found])

    return questions.mapInPandas(run, T.StructType([*questions.schema.fields, T.StructField("route", T.StringType()), T.StructField("reason", T.StringType())]))


def embedded(questions: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 48) -> DataFrame:
    """``questions`` (question and others) with embedding, by an embedder that is asked for ``batch`` at a time."""

    def run(frames):
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield part.assign(embedding=embedder(part["question"].fillna("").tolist()))

    return questions.mapInPandas(run, T.StructType([*questions.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def format_rows(result: Result, shown: int = SHOWN) -> str:
    head = " | ".join(result.columns)
    body = [" | ".join("" if v is None else str(v) for v in row) for row in result.rows[:shown]]
    note = [f"(showing {len(body)} of {result.row_count} rows)"] if result.row_count > len(body) else []
    return "\n".join([head, *body, *note])


def format_chunks(rows: list) -> str:
    """One paragraph for each chunk, with its id and a mark where a program wrote it."""
    parts = []
    for r in rows:
        d = r.asDict()
        mark = " [automated]" if d.get("is_bot_generated") else ""
        parts.append(f"[{d['chunk_id']}]{mark} {d.get('context_text') or ''}\n{d['raw_text']}".strip())
    return "\n\n".join(parts)


@dataclass
class Answer:
    question: str
    route: Route
    text: str
    chunk_ids: list = field(default_factory=list)
    result: Result | None = None


def paragraphs(rows: DataFrame) -> DataFrame:
    """query_id, chunk_ids and evidence (what format_chunks makes) of chunks' rows with query_id and rank."""
    or_empty = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    mark = F.when(F.coalesce(F.col("is_bot_generated"), F.lit(False)), " [automated]").otherwise("") if "is_bot_generated" in rows.columns else F.lit("")
    text = F.rtrim(F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("]"), mark, F.lit(" "), or_empty("context_text"), F.lit("\n"), or_empty("raw_text")), F.lit(" \t\n\x0b\f\r"))
    best = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", text.alias("text")))).alias("best"))
    return best.select("query_id", F.col("best.chunk_id").alias("chunk_ids"), F.array_join("best.text", "\n\n").alias("evidence"))


@dataclass
class Engine:
    """The parts of question answering: a corpus with its index and vectors, the guarded lane and the injected models.

    The index is postings or a block index, the vectors a table or a cluster index. ``embed`` is asked for one text at a time;
    ``embed_many``, where there is one, for many.
    """

    spark: SparkSession
    chunks: DataFrame
    index: DataFrame | BlockIndex
    vectors: DataFrame | ClusterIndex
    embed: Callable[[str], list[float]] | None = None
    guard: Guard | None = None
    generate: Callable[[str, str | None, str | None], str] | None = None
    router: Callable[[str], Route] = rule_router
    write: Callable[[str, str], str] = staticmethod(lambda question, evidence: evidence)
    embed_many: Callable[[list[str]], list[list[float]]] | None = None
    stemmed: bool = True
    plain: bool = False

    def _lanes(self, queries: DataFrame, within: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        asked = retrieval.plain(queries) if self.plain else queries
        keyword = blocks.search(self.index, asked, within=within) if isinstance(self.index, BlockIndex) else retrieval.keyword_search(self.index, asked, within=within, stemmed=self.stemmed)
        vectors = self.vectors.vectors().select("chunk_id", "embedding") if isinstance(self.vectors, ClusterIndex) else self.vectors
        if within is not None and "query_id" in within.columns:
            return keyword, retrieval.dense_within(vectors, queries, within)
        if isinstance(self.vectors, ClusterIndex):
            return keyword, clusters.search(self.vectors, queries, within=within)
        return keyword, retrieval.dense_search(vectors, queries, within=within)

    def top(self, questions: DataFrame, within: DataFrame | None = None, n: int = 6) -> DataFrame:
        """The n best chunks of each question (query_id, question, perhaps embedding) with their rows and rank, in one plan for all.

        ``within``: chunk_id, or query_id and chunk_id; of the latter, a question without a row has no chunk.
        """
        if "embedding" not in questions.columns:
            embed = self.embed
            questions = embedded(questions, self.embed_many or (lambda texts: [embed(t) for t in texts]))
        queries = kept(questions.select("query_id", F.col("question").alias("query"), F.col("embedding").cast("array<float>").alias("embedding")), "questions")
        best = retrieval.rerank(retrieval.fuse(*self._lanes(queries, within)), queries, self.chunks, n)
        return best.select("query_id", "chunk_id", "rank").join(self.chunks, "chunk_id")

    def evidence(self, questions: DataFrame, jobs: DataFrame | None = None, n: int = 6) -> DataFrame:
        """query_id, route, reason, chunk_ids and evidence of each question (query_id, question, perhaps embedding), many in one plan.

        ``jobs`` (query_id, job_id): what a structured query found; a question with such rows is answered from the notes of these jobs,
        one without from all. Refused questions have the refusal and no chunks; one for which nothing is found has an empty text.
        """
        asked = kept(routes(questions, self.router), "routes")
        wanted = asked.where("route != 'refuse'").drop("route", "reason")
        if jobs is None:
            found = self.top(wanted, n=n)
        else:
            pairs = jobs.where(F.col("job_id").isNotNull()).select("query_id", "job_id").distinct()
            narrow = pairs.select("query_id").distinct()
            within = self.chunks.select("chunk_id", "job_id").join(pairs, "job_id").select("query_id", "chunk_id")
            found = self.top(wanted.join(narrow, "query_id", "left_anti"), n=n).unionByName(self.top(wanted.join(narrow, "query_id", "left_semi"), within, n))
        out = asked.select("query_id", "route", "reason").join(paragraphs(found), "query_id", "left")
        none = F.array().cast(T.ArrayType(self.chunks.schema["chunk_id"].dataType))
        return out.withColumns({"chunk_ids": F.coalesce("chunk_ids", none), "evidence": F.when(F.col("route") == "refuse", REFUSAL).otherwise(F.coalesce("evidence", F.lit("")))})

    def retrieve(self, question: str, within: DataFrame | None = None, n: int = 6) -> list:
        """The same for one question."""
        one = self.spark.createDataFrame([(0, question)], "query_id bigint, question string")
        return self.top(one, within, n).orderBy("rank").collect()

    def structured(self, question: str) -> Result | None:
        """None where the lane is missing or fails, so that the caller falls back to the notes."""
        if self.guard is None or self.generate is None:
            return None
        try:
            return run_structured(self.guard, question, self.generate)
        except (Rejected, TimeoutError, PySparkException):
            return None

    def answer(self, question: str) -> Answer:
        chosen = route(question, self.router)
        if chosen.route == "refuse":
            return Answer(question, chosen, REFUSAL)
        result = self.structured(question) if chosen.route in ("structured", "hybrid") else None
        if chosen.route == "structured" and result is not None:
            return Answer(question, chosen, self.write(question, format_rows(result)), result=result)
        within = None
        if result is not None:  # all jobs found, not only the rows shown
            picked = retrieval.narrowed(self.chunks, result.frame)
            within = None if picked is self.chunks else picked.select("chunk_id")
        rows = self.retrieve(question, within)
        evidence = "\n\n".join(x for x in (format_rows(result) if result else "", format_chunks(rows)) if x)
        return Answer(question, chosen, self.write(question, evidence), [r["chunk_id"] for r in rows], result)
