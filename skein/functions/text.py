"""Text search: terms and cover density as Column functions, and the syntax of queries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words without meaning for a search.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do "
    "does doing don down during each few for from further had has have having he her here hers him his how i if in into is it its just "
    "me more most my no nor not now of off on once only or other our out over own s same she should so some such t than that the their "
    "them then there these they this those through to too under until up very was we were what when where which while who whom why will "
    "with you your"
).split()
def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def words_joined(text: Column) -> Column:
    """The same with a blank between, without an array of them."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def terms(text: Column) -> Column:
    """Array of struct(term, pos): the words to search by with their places among all words; stop words hold a place but are no terms."""
    placed = F.transform(words(text), lambda w, i: F.struct(w.alias("term"), (i + 1).cast("int").alias("pos")))
    return F.filter(placed, lambda r: ~r.term.isin(STOP_WORDS))


def term_rows(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with term and pos, a row for each of terms(text): one generator over the split text, without arrays of structs."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    names = [F.col(f"`{c}`") for c in rows.columns]
    # a text that begins with another character has an empty part first, which is no word
    split = rows.withColumn("_parts", parts).withColumn("_skip", (F.get("_parts", F.lit(0)) == "").cast("int"))
    out = split.select(*names, "_skip", F.posexplode("_parts").alias("_at", "term"))
    return out.where((F.col("term") != "") & ~F.col("term").isin(STOP_WORDS)).select(*names, "term", (F.col("_at") + 1 - F.col("_skip")).alias("pos"))


def search_text(raw: Column, context: Column) -> Column:
    return F.concat_ws("\n", context, raw)


@dataclass(frozen=True)
class Clause:
    """Words that must stand together in this order; any of the alternatives of a clause will do."""

    phrases: tuple[tuple[str, ...], ...]
    negated: bool = False


def web_query(text: str) -> list[Clause]:
    """The clauses of a query in web-search syntax: "quoted phrases", ``or`` between two items and ``-`` before one."""
    clauses: list[Clause] = []
    either = False
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if bare.lower() == "or" and not minus:
            either = bool(clauses)
            continue
        phrase = tuple(re.findall(r"[^\W_]+", (quoted or bare).lower()))
        if phrase:
            if either and not minus and not clauses[-1].negated:
                clauses[-1] = Clause((*clauses[-1].phrases, phrase))
            else:
                clauses.append(Clause((phrase,), bool(minus)))
        either = False
    return clauses


def cover_density(hits: Column, n_terms: Column) -> Column:
    """The sum over the covers of a tenth over one and the words in the cover that are no hits.

    ``hits``: array of struct(pos, nth) in order of pos, nth from 0 to n - 1. A cover is a shortest span that holds all n. One
    pass keeps the last hit of each; a cover ends where the earliest of these moves on.
    """
    start = F.struct(F.array_repeat(F.lit(0), n_terms.cast("int")).alias("last"), F.lit(0).alias("from"), F.lit(0.0).alias("sum"))
    placed = F.transform(hits, lambda h, i: F.struct(h["pos"].alias("pos"), h["nth"].alias("nth"), (i + 1).cast("int").alias("i")))

    def step(s: Column, h: Column) -> Column:
        last = F.transform(s["last"], lambda x, i: F.when(i == h["nth"], h["i"]).otherwise(x))
        low = F.array_min(last)
        fresh = low > s["from"]
        noise = F.greatest(h["pos"] - F.get(hits, low - 1)["pos"] - (h["i"] - low), F.lit(0))
        return F.struct(last.alias("last"), F.when(fresh, low).otherwise(s["from"]).alias("from"), (s["sum"] + F.when(fresh, 0.1 / (1.0 + noise)).otherwise(0.0)).alias("sum"))

    return F.aggregate(placed, start, step, lambda s: s["sum"])
