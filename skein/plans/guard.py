"""Generated SQL under guard: one plain SELECT over the curated views, with known functions, a row limit and a time limit."""

from __future__ import annotations

import itertools
import re
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.tables import shared_dir

MAX_ROWS = 200
#: Rows that come to the driver at most, whatever limit a query has.
MOST_SHOWN = 10_000
TIMEOUT = 10.0
#: The plan nodes, by class, that a query may have, and the functions it may call.
WRAPPERS = {"GlobalLimit", "LocalLimit", "Sort", "Distinct", "UnresolvedWith"}
ROOTS = {"Project", "Aggregate", "UnresolvedHaving"}
NODES = WRAPPERS | ROOTS | {"Filter", "Join", "SubqueryAlias", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "OneRowRelation", "Union"}
FUNCTIONS = set(
    "abs avg bool_and bool_or bround ceil ceiling char_length coalesce concat concat_ws contains count count_if current_date date_add date_diff "
    "date_format date_sub date_trunc datediff day dayofmonth dayofweek dense_rank endswith every first floor greatest if ifnull initcap instr "
    "isnotnull isnull last least left length lower lpad ltrim max max_by mean median min min_by mod month months_between nullif nvl percentile "
    "percentile_approx power quarter rank regexp_extract regexp_replace replace right round row_number rpad rtrim sign some split sqrt startswith "
    "stddev substr substring sum to_date trim trunc try_cast try_divide upper variance weekofyear when year lag lead ntile array_join "
    "sort_array collect_set collect_list listagg string_agg make_date last_day like ilike rlike and or not in".split()
)


#: A limit at the end of a query. A limit of a subquery is followed by a parenthesis.
_LIMIT = re.compile(r"\s+limit\s+(\d+|all)\s*$", re.I)


#: Keywords and functions beside which the value of a whole number decides nothing: none that take ordinals, limits, frames, types or arguments checked by value.
VALUE_FREE = set("select from where with as in and or is null not distinct on join exists drop table insert into values set range".split())
_AGGREGATES = {"count", "max", "min", "sum", "avg"}
_QUOTED = re.compile(r"'[^'\\\\]*'")
_NUMBER = re.compile(r"(?<![A-Za-z0-9_.])(?:0|[1-9]\d{0,8})(?![A-Za-z0-9_.])|(?<=[A-Za-z]_)(?:0|[1-9]\d{0,8})(?![A-Za-z0-9_.])")
#: Shapes that are judged before their verdicts are written.
SHAPES = 10_000


def shape(sql: str, words: set[str]) -> str:
    """``~`` and the statement with its whole numbers replaced by their order of first appearance; ``=`` and the statement as it stands where the value of one might matter.

    ``words`` are the keywords and functions not in VALUE_FREE, in lower case. Numbers are replaced, those that end names and those in
    backticks included, only if all of them are of at most nine digits without leading zeros and there is no arithmetic, comment or
    other sign: statements of one shape then parse to the same plan but for those values, and equal numbers stay equal.
    """
    text = unfenced(sql)
    bare = _QUOTED.sub("''", text)
    plain = re.sub(r"`[^`'\"\\\\]*`", " ", bare)
    signs = re.sub(r"\(\s*\*\s*\)|(?i:\bselect\s+\*)", " ", plain)
    if not re.fullmatch(r"[A-Za-z0-9_\s,()=<>!.;']*", signs) or any(c.isdigit() for q in _QUOTED.findall(text) for c in q) or re.search(r"\d", _NUMBER.sub("", text)):
        return "=" + text
    if any(w in words for w in re.findall(r"[a-z_]\w*", plain.lower())):
        return "=" + text
    seen: dict[str, int] = {}
    return "~" + _NUMBER.sub(lambda m: f"\0{seen.setdefault(m[0], len(seen))}\0", text)


class Rejected(ValueError):
    """The query is not allowed."""


def unfenced(sql: str) -> str:
    """The query without a Markdown code fence and a closing semicolon."""
    text = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", sql.strip())
    return text.strip().rstrip(";").strip()


def _seq(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _nodes(plan) -> Iterator[tuple[str, object]]:
    """('plan', node) and ('expression', node) for all of a parsed plan, subqueries and WITH queries included."""
    yield "plan", plan
    if _name(plan) == "UnresolvedWith":
        for pair in _seq(plan.cteRelations()):
            yield from _nodes(pair._2())
    for child in _seq(plan.children()):
        yield from _nodes(child)
    for inner in _seq(plan.subqueries()):
        yield from _nodes(inner)
    stack = _seq(plan.expressions())
    while stack:
        e = stack.pop()
        yield "expression", e
        stack += _seq(e.children())


def _root(plan) -> str:
    name = _name(plan)
    while name in WRAPPERS:
        plan = plan.children().apply(0)
        name = _name(plan)
    return name


@dataclass
class Result:
    """Rows shown, all rows the query has, and the query as it ran."""

    sql: str
    columns: list[str]
    rows: list
    row_count: int
    frame: DataFrame


class Guard:
    """Runs queries in a session of its own that holds only the given views.

    ``build`` makes the views in the session it gets. A query without a limit of its own shows ``max_rows`` rows, one with a limit that
    many, but no more than ``most_shown``, as they come to the driver; row_count tells how many there are without any limit at the
    query's end, and the frame has them all.
    """

    def __init__(self, spark: SparkSession, build: Callable[[SparkSession], dict[str, DataFrame]], max_rows: int = MAX_ROWS, timeout: float = TIMEOUT, most_shown: int = MOST_SHOWN) -> None:
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")
        self.views = build(self.session)
        for name, df in self.views.items():
            df.createOrReplaceTempView(name)
        self.max_rows, self.timeout, self.most_shown = max_rows, timeout, most_shown

    def frame(self, sql: str) -> DataFrame:
        """The query as a DataFrame, not yet limited; Rejected if it is not allowed."""
        text = unfenced(sql)
        if not text:
            raise Rejected("empty query")
        try:
            plan = self.session._jsparkSession.sessionState().sqlParser().parsePlan(text)
        except Exception as e:
            raise Rejected(f"not one readable statement: {str(e)[:300]}") from e
        if _root(plan) not in ROOTS:
            raise Rejected(f"not a plain SELECT: {_root(plan)}")
        found = list(_nodes(plan))
        named = {pair._1().lower() for kind, n in found if kind == "plan" and _name(n) == "UnresolvedWith" for pair in _seq(n.cteRelations())}
        if named & {v.lower() for v in self.views}:
            raise Rejected("a WITH query takes the name of a view")
        for kind, n in found:
            name = _name(n)
            if kind == "plan" and name not in NODES:
                raise Rejected(f"not allowed: {name}")
            if name == "UnresolvedRelation":
                parts = [p.lower() for p in _seq(n.multipartIdentifier())]
                if len(parts) != 1 or (parts[0] not in named and parts[0] not in {v.lower() for v in self.views}):
                    raise Rejected(f"unknown table: {'.'.join(parts)}")
            if name == "UnresolvedFunction":
                parts = [p.lower() for p in _seq(n.nameParts())]
                if len(parts) != 1 or parts[0] not in FUNCTIONS:
                    raise Rejected(f"function not allowed: {'.'.join(parts)}")
        try:
            return self.session.sql(text)
        except PySparkException as e:
            raise Rejected(str(e)[:300]) from e

    def verdict(self, sql: str) -> str:
        """``allowed``, or why not, without the details that name the statement's own words."""
        try:
            self.frame(sql)
        except Rejected as e:
            return "not resolved" if isinstance(e.__cause__, PySparkException) and not str(e).startswith("not one") else str(e).partition(":")[0]
        return "allowed"

    def verdicts(self, statements: DataFrame) -> DataFrame:
        """``statements`` (sql and others) with verdict. Those of one shape have one verdict, so one of each is parsed, in the driver."""
        keywords = {r[0].lower() for r in self.session.sql("SELECT keyword FROM sql_keywords()").collect()}  # a few hundred
        words = (keywords | FUNCTIONS) - VALUE_FREE - _AGGREGATES
        names = {n.lower() for v, df in self.views.items() for n in (v, *df.columns)}
        fixed = any(c.isdigit() for n in names for c in n)  # a number might make the name of a view or column

        @F.pandas_udf("string")
        def shaped(sql: pd.Series) -> pd.Series:
            return sql.map(unfenced if fixed else lambda s: shape(s, words))

        spark = statements.sparkSession
        rows = statements.withColumn("shape", shaped(F.coalesce("sql", F.lit(""))))
        path = f"{shared_dir(spark)}/skein-verdicts-{uuid.uuid4().hex}"
        found = rows.groupBy("shape").agg(F.min(F.coalesce("sql", F.lit(""))).alias("sql"))
        judged = ((r.shape, self.verdict(r.sql)) for r in found.toLocalIterator())
        spark.createDataFrame([], "shape string, verdict string").write.parquet(path)
        while part := list(itertools.islice(judged, SHAPES)):
            spark.createDataFrame(part, "shape string, verdict string").write.mode("append").parquet(path)
        return rows.join(spark.read.schema("shape string, verdict string").parquet(path), "shape").drop("shape")

    def run(self, sql: str) -> Result:
        df, text = self.frame(sql), unfenced(sql)
        whole = _LIMIT.sub("", text)
        own = whole != text
        group, out, fault = uuid.uuid4().hex, [], []

        def work() -> None:
            try:
                self.session.sparkContext.setJobGroup(group, "guarded query", True)
                rows = df.limit(self.most_shown if own else self.max_rows + 1).collect()
                if own and rows:
                    n = self.session.sql(whole).count()
                else:
                    n = len(rows) if len(rows) <= self.max_rows else df.count()
                out.extend([rows if own else rows[: self.max_rows], n])
            except Exception as e:
                fault.append(e)

        thread = threading.Thread(target=work, daemon=True)
        thread.start()
        thread.join(self.timeout)
        if thread.is_alive():
            for _ in range(150):  # a query that is still being planned starts its jobs after the first attempt
                self.session.sparkContext.cancelJobGroup(group)
                thread.join(0.2)
                if not thread.is_alive():
                    break
            raise TimeoutError(f"stopped after {self.timeout} s")
        if fault:
            raise fault[0]
        return Result(text, df.columns, out[0], out[1], df)


def run_structured(guard: Guard, question: str, generate: Callable[[str, str | None, str | None], str]) -> Result:
    """Asks ``generate`` (question, bad query, error) for SQL and runs it; a query that fails may be mended once."""
    sql = generate(question, None, None)
    try:
        return guard.run(sql)
    except Exception as e:
        return guard.run(generate(question, sql, str(e)))
