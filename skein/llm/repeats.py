"""Repeated windows of L values (bytes or words) over a whole corpus, without a row for each position.

1. Every window's anchor (the smallest-hashed k-gram in it) is a prefix that its equals share at the same place: one row for
   each run of windows with one anchor, its context. Contexts whose anchor stands nowhere else end here.
2. Equal contexts are counted before they are shuffled, so each different one travels once, to the group of its anchor.
3. A group of more than GROUP contexts gets longer prefixes: its windows are dealt in halves by where the anchor stands in
   them, each half to the longer gram that all its windows hold, until groups fit; in the end the prefix is the window.
4. In a group, suffix order settles every window: by smaller positions before and after it (bytes), or by the smallest
   document below a deep node of the suffix tree (words), to which a context brings the smallest of its own. What it says of a
   context goes back to all its occurrences; a word's goes where its document is not that smallest one.
Each result is a span of removed windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import kernels as K
from skein.llm.common import batches, bytes_of, column_np, discard, stash, written

#: Most contexts of one prefix that meet in a task, and most values whose suffixes are ordered at a time.
GROUP, CHUNK = 4000, 1 << 19
#: What becomes of a run of windows: it goes at every occurrence of its context, or at those after the first.
ALL, LATER = 1, 2


def _long(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in names])


#: A context at a place: windows that start in [lo, hi] have their anchor at ``at``.
PLACE = _long("key", "ctx", "doc_id", "th", "lo", "hi", "at")
#: A different context, first found at (doc_id, th, lo) and ``n`` times in all; its anchor is ``at`` values in and lies [a, b) values in its windows.
STRING = _long("key", "ctx", "doc_id", "th", "lo", "n", "at", "a", "b").append(pa.field("vals", pa.binary()))
#: The same cut from the string (of, of_ctx), ``skip`` values in.
PIECE = _long("of", "of_ctx", "skip", *STRING.names[:-1]).append(pa.field("vals", pa.binary()))
#: What becomes of the windows [lo, hi] of a context that is first found at (first_doc, first_th, first_lo): ALL or LATER, or, where documents count, the smallest document below their node.
FATE = _long("key", "ctx", "first_doc", "first_th", "first_lo", "lo", "hi", "fate")


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in schema)


@dataclass(frozen=True)
class Kind:
    """What counts as a value, the window (k + w - 1 values) and which of equal windows go.

    keep: "none" (all that have an equal), "first" (all but the first by id and place), "document" (those whose equal is in
    a document with a smaller id).
    """

    k: int
    w: int
    keep: str
    words: bool

    @property
    def length(self) -> int:
        return self.k + self.w - 1

    @property
    def dtype(self) -> type:
        return np.uint64 if self.words else np.uint8

    def values(self, text) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        return K.word_hashes(data)[2] if self.words else data

    def hashed(self, values: np.ndarray) -> np.ndarray:
        return values if self.words else K.byte_values(values)


def _places(kind: Kind) -> Callable:
    """The contexts of all texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids, ths = column_np(batch, "doc_id"), column_np(batch, "th")
            found, home, size = [], [], 0
            for i, text in enumerate(bytes_of(batch.column(2))):
                a = K.anchors(kind.hashed(kind.values(text)), kind.k, kind.w)
                if len(a[0]):
                    found.append(a)
                    home.append(i)
                    size += len(a[0])
                if found and (size > CHUNK or i == len(batch) - 1):
                    yield from out(found, np.repeat(home, [len(f[0]) for f in found]), ids, ths)
                    found, home, size = [], [], 0
            if found:
                yield from out(found, np.repeat(home, [len(f[0]) for f in found]), ids, ths)

    def out(found: list, home: np.ndarray, ids: np.ndarray, ths: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, ctx, lo, hi, at = (np.concatenate(x) for x in zip(*found, strict=True))
        return batches(PLACE, [key.view(np.int64), ctx.view(np.int64), ids[home], ths[home], lo, hi, at])

    return run


def _strings(kind: Kind) -> Callable:
    """The values of the contexts first found in these documents."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids, ths, lists = column_np(batch, "doc_id"), column_np(batch, "th"), batch.column(3)
            out: list[list] = [[] for _ in STRING]
            for i, text in enumerate(bytes_of(batch.column(2))):
                values = np.ascontiguousarray(kind.values(text))
                rows = lists[i].values
                key, ctx, lo, wide, n, at = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("key", "ctx", "lo", "wide", "n", "at"))
                for r in range(len(lo)):
                    for c, v in zip(out, (key[r], ctx[r], ids[i], ths[i], lo[r], n[r], at[r], 0, kind.w, values[lo[r] : lo[r] + wide[r] + kind.length].tobytes()), strict=True):
                        c.append(v)
                if len(out[0]) > 20_000:
                    yield from batches(STRING, out)
                    out = [[] for _ in STRING]
            yield from batches(STRING, out)

    return run


def _lengthened(kind: Kind) -> Callable:
    """Strings in two pieces: windows in which the anchor lies far in, and the others, each under the gram that they share."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out: list[list] = [[] for _ in PIECE]
            for r in batch.to_pylist():
                values, at, mid = np.frombuffer(r["vals"], kind.dtype), r["at"], (r["a"] + r["b"]) // 2
                sums = K.prefix_sums(kind.hashed(values))
                last = len(values) - kind.length
                for a, b, lo, hi in ((mid, r["b"], 0, min(last, at - mid)), (r["a"], mid, max(0, at - mid + 1), last)):
                    if lo > hi:
                        continue
                    edges = np.array([at - a, lo]), np.array([at - b + 1, hi]) + kind.length
                    gram, whole = K.span_hash(sums, *edges)
                    key = K.mix(gram + np.uint64(a * 2 * kind.length + b))
                    ctx = K.mix(whole ^ np.uint64((hi - lo) * 1000003 + (at - lo) + 1))
                    for c, v in zip(out, (r["key"], r["ctx"], lo, key.view(np.int64), ctx.view(np.int64), r["doc_id"], r["th"], r["lo"] + lo, r["n"], at - lo, a, b, values[lo : hi + kind.length].tobytes()), strict=True):
                        c.append(v)
            yield from batches(PIECE, out)

    return run


def _ordered(kind: Kind) -> Callable:
    """Settles the windows of strings, which come sorted by key and context, by their suffix order."""
    width = np.dtype(kind.dtype).itemsize

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        # places in the joined values are then places in the corpus; what occurs again is laid down once more, behind them
        rows.sort(key=lambda r: r[2:5])
        first = len(rows)
        if kind.keep != "document":
            rows = rows + [r for r in rows if r[5] > 1]
        data = np.frombuffer(b"".join(r[9] for r in rows), kind.dtype)
        sizes = np.array([len(r[9]) // width for r in rows])
        home = np.repeat(np.arange(len(rows)), sizes)
        start = np.cumsum(sizes) - sizes
        rest = (start + sizes)[home] - np.arange(len(data))
        inside = rest >= kind.length  # a whole window starts here
        order, ranks = K.suffix_order(data, kind.length) if kind.words else K.suffix_order(K.pack_bytes(data), kind.length, 7)
        order, at = order[inside[order]], np.flatnonzero(inside)
        again = np.array([r[5] > 1 for r in rows])[home]
        fate = np.zeros(len(data), np.int64)
        if kind.keep == "document":
            doc = np.array([r[2] for r in rows])[home]
            fate = smallest_below(data, order, rest, doc, kind.length)
            at = at[(fate[at] < doc[at]) | again[at]]  # of the others no occurrence is in a greater document
        else:
            local = np.full(len(data), -1, np.int64)
            local[at] = np.arange(len(at))
            earlier, later = K.previous_factors(local[order], ranks[at])
            copies = int(start[first]) if first < len(rows) else len(data)
            fate[at[earlier | later if kind.keep == "none" else earlier]] = ALL
            # the second of two is there for the later ones of its kind
            if kind.keep == "first":
                twins = np.flatnonzero(again[:copies])
                fate[twins] = np.where(fate[twins] == 0, LATER * (fate[copies : copies + len(twins)] > 0), fate[twins])
            at = at[(at < copies) & (fate[at] > 0)]
        yield from runs(rows, home[at], at - start[home[at]], fate[at])

    def runs(rows: list[tuple], row: np.ndarray, place: np.ndarray, fate: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(row):
            return
        cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | (fate[1:] != fate[:-1])]))
        end = np.append(cut[1:], len(row)) - 1
        own = np.array([r[:5] for r in rows], np.int64)[row[cut]]
        yield from batches(FATE, [*own.T, place[cut], place[end], fate[cut]])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in parts:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for r in zip(*cols, strict=True):
                if r[:2] == last:  # from a repeated row of the same id and text
                    continue
                if size > CHUNK * width and r[0] != last[0]:
                    yield from settle(rows)
                    rows, size = [], 0
                rows.append(r)
                size, last = size + len(r[9]), r[:2]
        if rows:
            yield from settle(rows)

    return run


def smallest_below(data: np.ndarray, order: np.ndarray, rest: np.ndarray, doc: np.ndarray, depth: int) -> np.ndarray:
    """For each place the smallest document below the highest node of at least this depth over its suffix; the place's own where there is none.

    order: suffixes in order; rest: how many values each may use; doc: the smallest document that each place stands for. The nodes
    are the intervals of the suffix tree in which neighbours have so long a common prefix; deeper nodes lie within them and have
    no other documents.
    """
    out = doc.copy()
    if len(order):
        start = np.flatnonzero(K.common_prefixes(data, order, rest) < depth)
        out[order] = np.repeat(np.minimum.reduceat(doc[order], start), np.diff(np.append(start, len(order))))
    return out


def fates(kind: Kind, strings: DataFrame) -> DataFrame:
    """FATE of all strings (different ones); those of too large groups by longer prefixes."""
    strings = strings.select(*STRING.names)
    large = stash(strings.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > GROUP).select("key"), "large")
    some = not large.isEmpty()
    own = strings.join(large, "key", "left_anti").select(*STRING.names) if some else strings
    settled = own.repartition("key").sortWithinPartitions("key", "ctx").mapInArrow(_ordered(kind), _ddl(FATE))
    if not some:
        return settled
    hot = strings.join(large, "key", "left_semi").select(*STRING.names).dropDuplicates(["key", "ctx"])
    pieces = stash(hot.mapInArrow(_lengthened(kind), _ddl(PIECE)), "pieces")
    first = F.min(F.struct("doc_id", "th", "lo")).alias("first")
    longer = stash(pieces.groupBy("key", "ctx").agg(first, F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("at", "a", "b", "vals")]).select("key", "ctx", "first.*", "n", "at", "a", "b", "vals"), "longer")
    found = fates(kind, longer).withColumnsRenamed({"lo": "from", "hi": "to"}).join(pieces.drop("vals", "a", "b", "at"), ["key", "ctx"])
    fate = F.col("fate") if kind.keep == "document" else F.when(_goes(kind), ALL).otherwise(LATER).cast("long").alias("fate")
    found = found.select(F.col("of").alias("key"), F.col("of_ctx").alias("ctx"), F.col("doc_id").alias("first_doc"), F.col("th").alias("first_th"), (F.col("lo") - F.col("skip")).alias("first_lo"), (F.col("skip") + F.col("from")).alias("lo"), (F.col("skip") + F.col("to")).alias("hi"), fate)
    return settled.unionByName(found)


def _goes(kind: Kind):
    """Whether an occurrence goes by its fate."""
    if kind.keep == "document":
        return F.col("doc_id") > F.col("fate")
    return (F.col("fate") == ALL) | (F.struct("doc_id", "th", "lo") > F.struct("first_doc", "first_th", "first_lo"))


def removed_spans(docs: DataFrame, kind: Kind) -> DataFrame:
    """doc_id, th and spans (array of lo, hi) of each document (of doc_id, th, text) that loses something."""
    # the text travels to its documents' spans twice: for the contexts and for the result
    every, path = written(docs.mapInArrow(_places(kind), _ddl(PLACE)), "places")
    # written, so that the join may split a prefix that has very many rows
    again = stash(every.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key"), "again")
    places = stash(every.join(again, "key"), "repeats")
    discard(docs.sparkSession, path)
    first = F.min(F.struct("doc_id", "th", "lo")).alias("first")
    contexts = places.groupBy("key", "ctx").agg(first, F.count("*").alias("n"), F.min(F.col("hi") - F.col("lo")).alias("wide"), F.min(F.col("at") - F.col("lo")).alias("at"))
    todo = contexts.groupBy(F.col("first.doc_id"), F.col("first.th")).agg(F.collect_list(F.struct("key", "ctx", F.col("first.lo").alias("lo"), "wide", "n", "at")).alias("rows"))
    strings = stash(docs.join(todo, ["doc_id", "th"]).select("doc_id", "th", "text", "rows").mapInArrow(_strings(kind), _ddl(STRING)), "strings")
    found = fates(kind, strings).withColumnsRenamed({"lo": "from", "hi": "to"})
    spans = places.join(found, ["key", "ctx"]).where(_goes(kind)).select("doc_id", "th", (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to") + kind.length).alias("hi"))
    return spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def with_spans(docs: DataFrame, kind: Kind) -> DataFrame:
    """docs (doc_id, th, text) with spans, null where nothing goes."""
    return docs.join(removed_spans(docs, kind), ["doc_id", "th"], "left").select("doc_id", "th", "text", "spans")


def merged_spans(cell) -> tuple[np.ndarray, np.ndarray]:
    """A cell of spans as disjoint maximal ones."""
    if not cell.is_valid:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return K.merge_spans(cell.values.field("lo").to_numpy(zero_copy_only=False), cell.values.field("hi").to_numpy(zero_copy_only=False))
