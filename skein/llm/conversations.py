"""Conversation structure repair: the cheapest edits that make a conversation well formed, by dynamic programming over a shared trie.

A conversation is a string of tokens, one for each row: the initial of its role and its fault. Rows are dealt by range of
conversation and turn, so that even one conversation that holds a third of all rows is spread; where it is cut, and every SEGMENT
rows, a new segment begins. The distinct segments, sorted, are inserted into a prefix trie: a layer (for each state of the grammar
the least cost and, among equals, the least string of edits) is computed once for each prefix that segments share, and a segment's
answer is read at its end. Of the trie only the path to the segment at hand is alive, as sorted segments never return to a branch.
Segments that may continue a conversation are solved from every state, and a conversation composes its segments in order, which is
exact: costs add up, and edits of one cost and one state never begin with each other.

The repaired rows then stream through one task for each conversation in its order, as a digest of the whole is serial.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skein.llm.common import BLANKS, stash
from skein.sources.tables import table

SEGMENT = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a.
NONE, S, U, A = range(4)
GO = {(NONE, "s"): S, (NONE, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
LEGAL = ("su", "ua", "au")
#: A segment that begins a conversation starts with this token.
BEGIN = "^"

Layer = list  # of states: (cost, edits) or None


def inserted(layer: Layer) -> Layer:
    """The layer after inserts, in place."""
    for p, q in ((NONE, U), (S, U), (A, U), (U, A)):
        if layer[p] and (layer[q] is None or (layer[p][0] + INSERT, layer[p][1] + "I") < layer[q]):
            layer[q] = (layer[p][0] + INSERT, layer[p][1] + "I")
    return layer


def stepped(layer: Layer, token: str) -> Layer:
    """The layer after one more row: x must go, a capital is truncated, o is another role."""
    new: Layer = [None] * 4

    def offer(q: int | None, cost: int, edits: str) -> None:
        if q is not None and (new[q] is None or (cost, edits) < new[q]):
            new[q] = (cost, edits)

    for q, best in enumerate(layer):
        if best is None:
            continue
        cost, edits = best
        offer(q, cost + DELETE, edits + "D")
        if token != "x":
            kept = cost + TRUNCATED * token.isupper()
            offer(GO.get((q, token.lower())), kept + KEEP, edits + "K")
            for role in "ua":
                offer(GO.get((q, role)), kept + REROLE, edits + "R")
    return inserted(new)


class Trie:
    """The path of the last segment in a prefix trie; segments come sorted."""

    def __init__(self):
        self.tokens = ""
        self.layers: list[list[Layer]] = []

    def solve(self, segment: str) -> list[Layer]:
        """A layer for each state that the segment may start from (only NONE where it begins a conversation)."""
        shared = 0
        while shared < min(len(self.tokens), len(segment)) and self.tokens[shared] == segment[shared]:
            shared += 1
        if not shared:
            starts = [NONE] if segment[:1] == BEGIN else range(4)
            self.layers = [[inserted([(0, "") if q == start else None for q in range(4)]) for start in starts]]
        del self.layers[shared + 1 :]
        for token in segment[shared:]:
            before = self.layers[-1]
            self.layers.append(before if token == BEGIN else [stepped(layer, token) for layer in before])
        self.tokens = segment
        return self.layers[-1]


def composed(layer: Layer, moves: list[Layer]) -> Layer:
    """The layer after a segment that was solved from every state."""
    out: Layer = [None] * 4
    for best, ends in zip(layer, moves, strict=True):
        for q, move in enumerate(ends):
            if best and move and (out[q] is None or (best[0] + move[0], best[1] + move[1]) < out[q]):
                out[q] = (best[0] + move[0], best[1] + move[1])
    return out


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in parts:
        for lo in range(0, len(batch), 2000):
            yield from zip(*[c.to_pylist() for c in batch.slice(lo, 2000).columns], strict=True)


def _tables(schema: pa.Schema, rows: Iterator[tuple], most: int = 5000, size=None) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, and of about 8 MB by ``size`` of a row."""
    held: list[tuple] = []
    weight = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        weight += size(row) if size else 0
        if len(held) == most or weight > 8 << 20:
            yield out()
            held.clear()
            weight = 0
    if held:
        yield out()


COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def _segments(schema: pa.Schema):
    """Segments of each conversation from its rows in order (conv, turn, role, mark, first, n)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            nth = 0
            for at, (conv, run_) in enumerate(groupby(_rows(parts), key=lambda r: r[0])):
                tokens, counts, ends, least, most, old = [], dict.fromkeys(COUNTS, 0), None, None, None, None
                first = at > 0  # the first conversation of a task may have begun in the task before

                def segment() -> tuple:
                    nonlocal nth, first
                    out = (conv, part, nth, BEGIN * first + "".join(tokens), *counts.values(), *ends, least, most)
                    nth, first = nth + 1, False
                    return out

                for _, turn, role, mark, seen_first, n in run_:
                    initial = role[:1]
                    for copy in range(n):
                        fault = "blank" if mark == "blank" else "duplicate" if copy or not seen_first else mark
                        if len(tokens) == SEGMENT:
                            yield segment()
                            tokens, counts, ends, least, most = [], dict.fromkeys(COUNTS, 0), None, None, None
                        token = initial if initial in ("s", "u", "a") else "o"
                        tokens.append("x" if fault in ("blank", "duplicate") else token.upper() if fault == "truncated" else token)
                        if fault:
                            counts[fault] += 1
                        counts["illegal"] += ends is not None and ends[1] + initial not in LEGAL
                        counts["turns"] += turn is not None and (ends is None or ends[3] != turn)
                        ends = (initial, initial, turn, turn) if ends is None else (ends[0], initial, ends[2], turn)
                        least, most = turn if least is None else least, most if turn is None else turn
                yield segment()

        yield from _tables(schema, rows())

    return run


def _solved(schema: pa.Schema):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()

        def rows() -> Iterator[tuple]:
            for (segment,) in _rows(parts):
                flat = [best for layer in trie.solve(segment) for best in layer]
                yield segment, [b and b[0] for b in flat], [b and b[1] for b in flat]

        yield from _tables(schema, rows(), 500)

    return run


def _answers(schema: pa.Schema):
    """The answer of each conversation from its segments in order."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv, run_ in groupby(_rows(parts), key=lambda r: r[0]):
                total, ends, least, most = [0] * len(COUNTS), None, None, None
                layer = inserted([(0, ""), None, None, None])
                for _, _, _, segment, *rest in run_:
                    counts, (first, last, first_turn, last_turn, lo, hi), (costs, edits) = rest[:5], rest[5:11], rest[11:]
                    flat = [None if c is None else (c, e) for c, e in zip(costs, edits, strict=True)]
                    layer = flat if segment[:1] == BEGIN else composed(layer, [flat[q * 4 : q * 4 + 4] for q in range(4)])
                    total = [a + b for a, b in zip(total, counts, strict=True)]
                    if ends is not None:
                        total[3] += ends[0] + first not in LEGAL
                        total[4] -= first_turn is not None and ends[1] == first_turn
                    ends, least, most = (last, last_turn), lo if least is None else least, most if hi is None else hi
                cost, audit = min(x for x in (layer[NONE], layer[A]) if x)
                blank, duplicate, truncated, illegal, turns = total
                yield conv, 0 if least is None else most - least + 1 - turns, blank, duplicate, truncated, illegal, cost, audit

        yield from _tables(schema, rows(), size=lambda r: len(r[-1]))

    return run


def _repaired(schema: pa.Schema):
    """The rows that stay, with those inserted, from each conversation's edits followed by its rows in order (conv, edits, role, text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv, run_ in groupby(_rows(parts), key=lambda r: r[0]):
                place, state = 0, NONE
                edits = next(run_)[1]
                for edit in edits:
                    role, text = (None, "") if edit == "I" else next(run_)[2:]
                    if edit == "D":
                        continue
                    if edit != "K":  # the grammar leaves one of the two
                        role = "user" if state != U else "assistant"
                    state = GO[state, role[:1]]
                    yield conv, place, {"K": "keep", "R": "rerole", "I": "insert"}[edit], role, text
                    place += 1

        yield from _tables(schema, rows(), size=lambda r: len(r[-1]))

    return run


def _digests(schema: pa.Schema):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv, run_ in groupby(_rows(parts), key=lambda r: r[0]):
                digest = hashlib.sha256()
                for _, place, _, role, text in run_:
                    digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
                yield conv, digest.hexdigest()

        yield from _tables(schema, rows())

    return run


def _schemas(conv: T.DataType) -> dict[str, T.StructType]:
    def of(text: str) -> T.StructType:
        return T.StructType([T.StructField("conv_id", conv), *T._parse_datatype_string(text).fields])

    sums = ", ".join(f"{c} long" for c in COUNTS)
    return {
        "segments": of(f"part long, nth long, segment string, {sums}, first string, last string, first_turn long, last_turn long, least long, most long"),
        "solved": T._parse_datatype_string("segment string, costs array<long>, edits array<string>"),
        "answers": of("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"),
        "repaired": of("place long, edit string, role string, text string"),
        "digests": of("repaired_sha256 string"),
    }


def _map(df: DataFrame, step, schema: T.StructType) -> DataFrame:
    return df.mapInArrow(step(pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])), schema)


def plain(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role and text (nulls as one space), digest of the text."""
    text = F.coalesce(turns[f"`{text_col}`"], F.lit(" "))
    return turns.select(
        turns[f"`{conv_col}`"].alias("conv_id"), turns[f"`{turn_col}`"].cast("long").alias("turn"),
        F.coalesce(turns[f"`{role_col}`"], F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """Distinct rows of plain(), without their texts: their number n, mark (blank, truncated or null) and whether the text stands first in its role here."""
    bare = F.rtrim("text", F.lit(BLANKS))
    mark = F.when(bare == "", F.lit("blank")).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), F.lit("truncated"))
    some = rows.select("conv_id", "turn", "role", "digest", mark.alias("mark")).groupBy("conv_id", "turn", "role", "digest", "mark").agg(F.count("*").alias("n"))
    some = stash(some, "turns")
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    seen = some.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(order).alias("earliest"))
    both = some.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    return both.select("conv_id", "turn", "role", "digest", "mark", order.eqNullSafe(F.col("earliest")).alias("first"), "n")


def answers(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of plain()."""
    schemas = _schemas(rows.schema["conv_id"].dataType)
    order = ["conv_id", "turn", "role", "digest"]
    dealt = stash(marked(rows), "marked").repartitionByRange(*order).sortWithinPartitions(*order).drop("digest")
    segments = stash(_map(dealt, _segments, schemas["segments"]), "segments")
    distinct = stash(segments.select("segment").distinct(), "signatures")
    solved = stash(_map(distinct.repartitionByRange("segment").sortWithinPartitions("segment"), _solved, schemas["solved"]), "solved")
    met = segments.join(solved.withColumnRenamed("segment", "s"), F.col("segment") == F.col("s")).drop("s")
    return _map(met.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth"), _answers, schemas["answers"])


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, edit (keep, rerole, insert), role and text of what stays of plain(), in order within partitions, by the audits of answers()."""
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "binary"))]
    both = rows.withColumns({"kind": F.lit(1), "audit": F.lit(None).cast("string")}).unionByName(found.select("conv_id", "audit", F.lit(0).alias("kind"), *nothing))
    lines = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").select("conv_id", "audit", "role", "text")
    return _map(lines, _repaired, _schemas(rows.schema["conv_id"].dataType)["repaired"])


def digests(lines: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 from repaired(), of each conversation that keeps a row; relies on its order."""
    return _map(lines, _digests, _schemas(lines.schema["conv_id"].dataType)["digests"])


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """A row for each conversation (see answers) and the repaired rows (see repaired).

    Rows of a conversation go by turn (nulls first), then role and digest of the text; a null conversation is one of its own. Null
    roles and texts are one space. A blank row has no character beside white space; a duplicate has role and text of an earlier row; a
    truncated one does not end with ``.``, ``!`` or ``?``; the first of these faults counts. Keeping costs 0, another role 1, deleting
    2 (blank and duplicate rows must go), an empty row inserted 5, a truncated row that stays 5. Role initials must come to
    (s?(ua)+)?; an empty role has no initial, and such a row cannot stay as it is. Of the cheapest edits (Delete, Insert, Keep,
    Rerole) the least string is taken. Other columns are left out; an empty table gives empty results.
    """
    rows = plain(turns, conv_col, turn_col, role_col, text_col)
    found = stash(answers(rows), "answers")
    return found, repaired(rows, found)


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of a conversations table after the damage that crc32 of ``conv_id:turn`` deals out (nulls: one space)."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    harm = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    out = turns.withColumn("harm", harm).where("harm != 0").select(
        "conv_id", "turn",
        F.when(F.col("harm") == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1))).alias("copy"),
    )
    return out.drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, lines = repair(damaged(turns))
    found, lines = (df.withColumnRenamed("conv_id", "c") for df in (found, digests(lines)))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    out = turns.select("conv_id").distinct().join(found, same, "left").drop("c").join(lines, same, "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: crc32 of the UTF-8 of a column: the table of its polynomial, and a fold over the bytes.
CRC_TABLE = "SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) r(n)"


def crc_sql(text: str) -> str:
    """crc32 in DuckDB's words, over a row that also has the table ``t``."""
    byte = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce({byte}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295))"


def _best(*offers: tuple[str, str, str, str]) -> str:
    """The least of (state, condition, cost, edit): costs of ten digits come before the edits, so that strings compare as both."""
    return "least(" + ", ".join(f"CASE WHEN {when} THEN printf('%010d', CAST(substr({q}, 1, 10) AS BIGINT) + {cost}) || substr({q}, 11) || '{edit}' END" for q, when, cost, edit in offers) + ")"


OP12_SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}), h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS harm FROM conversations, crc
), d AS (
  SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE harm WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE harm <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM d
), f AS (
  SELECT *, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE 'c' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o
), n AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
         count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
), p AS (
  SELECT conv_id, 0 AS i, '0000000000' AS z, CAST(NULL AS VARCHAR) AS s, '0000000005I' AS u, '0000000010II' AS a FROM n
  UNION ALL
  SELECT conv_id, i, z, s, least(u, {_best(("z", "true", 5, "I"), ("s", "true", 5, "I"), ("a", "true", 5, "I"))}),
         least(a, {_best(("least(u, " + _best(("z", "true", 5, "I"), ("s", "true", 5, "I")) + ")", "true", 5, "I"))})
  FROM (
    SELECT p.conv_id, f.i, {_best(("z", "true", 2, "D"))} AS z,
           {_best(("s", "true", 2, "D"), ("z", "fault NOT IN ('b', 'd') AND r = 's'", "e", "K"))} AS s,
           {_best(("u", "true", 2, "D"), *[(q, w, c, k) for q in "zsa" for w, c, k in (("fault NOT IN ('b', 'd') AND r = 'u'", "e", "K"), ("fault NOT IN ('b', 'd')", "e + 1", "R"))])} AS u,
           {_best(("a", "true", 2, "D"), ("u", "fault NOT IN ('b', 'd') AND r = 'a'", "e", "K"), ("u", "fault NOT IN ('b', 'd')", "e + 1", "R"))} AS a
    FROM p JOIN (SELECT *, CASE fault WHEN 't' THEN 5 ELSE 0 END AS e FROM f) f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
  )
), b AS (
  SELECT n.conv_id, CAST(substr(least(z, a), 1, 10) AS BIGINT) AS cost, substr(least(z, a), 11) AS audit FROM p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = n.rows
), e AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS pos FROM b WHERE audit <> ''
), w AS (
  SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER g AS i, count(*) FILTER (WHERE edit <> 'D') OVER g AS place FROM e WINDOW g AS (PARTITION BY conv_id ORDER BY pos)
), k AS (
  SELECT w.*, f.role, f.text, f.r, first_value(edit || r) OVER (PARTITION BY w.conv_id ORDER BY pos) AS head FROM w LEFT JOIN f ON edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i WHERE edit <> 'D'
), x AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place % 2 = 1) = (head IS DISTINCT FROM 'Ks') THEN 'user' ELSE 'assistant' END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY pos)) AS sha
  FROM k GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
"""
