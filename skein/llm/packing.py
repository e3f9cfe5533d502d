"""Packing: documents as token ids in sequences of one length, by Karmarkar-Karp multiway differencing.

A document's ids fill whole sequences as far as they reach; what is left of it, less than a sequence, is an item. A task gathers
items until they would fill GROUP sequences and deals a group to windows by differencing: a partial partition is the sums of all
windows; the two of the widest spread are merged, the fullest windows of one with the emptiest of the other, until one is left. A
tenth of a group's ids, from its longest items, is cut to pieces of 64, 32, ... 1 ids first, so that the windows come out equal to an id or
two. What a group holds beyond whole windows makes sequences of powers of two, which need no padding. Where a window exceeds the
capacity, more is cut; where that does not help, the number of windows rises and the group is dealt anew.

Nothing is shuffled: a task holds one group at a time, so that a document that holds a third of all words is only a longer row.
A recomputed task gives the same sequences, as it reads the same rows in the same order.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skein.sources.tables import table

#: The vocabulary of byte_bpe_50k.json as ranks: the same ids in a quarter of the time (tests compare the two).
TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = {"<|endoftext|>": 50256}
END = 0
WINDOW, GROUP = 1024, 512
#: Lengths of the pieces that long items are cut to, in turn, and the shares of a group's ids that are cut so until no window overflows.
CUTS, SHARES = (64, 32, 16, 8, 4, 2, 1), (0.1, 0.3, 1.0)


def encoder(path: str = TOKENIZER) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(encoding: tiktoken.Encoding, text: str | None) -> np.ndarray:
    """The ids of a text (null: none) and END, as little-endian unsigned numbers of 32 bits."""
    found = encoding.encode(text, allowed_special="all") if text and "<|" in text else encoding.encode_ordinary(text or "")
    found.append(END)
    return np.array(found, "<u4")


def differenced(sizes: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """A window of k for each size, near-equal in sum, and the largest sum."""
    heap, sums, merged = [], {}, {}
    for i, size in enumerate(sizes.tolist()):
        sums[i] = np.zeros(k, np.int64)
        sums[i][-1] = size
        heap.append((-size, i))
    heapq.heapify(heap)
    new = len(sizes)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(both, kind="stable")
        sums[new], merged[new] = both[order], (a, b, order.astype(np.int32))
        heapq.heappush(heap, (int(both[order[0]] - both[order[-1]]), new))
        new += 1
    # from the last merge down: which window each slot of a partial partition has become
    found, open_ = np.zeros(len(sizes), np.int64), [(heap[0][1], np.arange(k, dtype=np.int32))]
    most = int(sums[heap[0][1]][-1])
    while open_:
        node, window = open_.pop()
        if node < len(sizes):
            found[node] = window[-1]
            continue
        a, b, order = merged[node]
        before = np.empty(k, np.int32)
        before[order] = window
        open_ += [(a, before), (b, before[::-1])]
    return found, most


def deal(sizes: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in the item, length) of at most ``window`` ids that hold all items."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    k, rest = divmod(sum(sizes), window)
    out: list[list[tuple[int, int, int]]] = []
    at = {i: 0 for i in order}
    short = iter(order)
    i = next(short, None)
    for bit in reversed(range(window.bit_length())):  # what is beyond whole windows, from the shortest items
        if not rest >> bit & 1:
            continue
        need, sequence = 1 << bit, []
        while need:
            n = min(need, sizes[i] - at[i])
            sequence.append((i, at[i], n))
            at[i], need = at[i] + n, need - n
            if at[i] == sizes[i]:
                i = next(short, None)
        out.append(sequence)
    if not k:
        return out
    cuts = [window >> j for j in range(4, window.bit_length())] or [1]
    for share in SHARES:
        pieces, left = [], share * k * window
        for i in reversed(order):
            lo, turn = at[i], 0
            while lo < sizes[i]:
                n = min(cuts[turn % len(cuts)], sizes[i] - lo) if left > 0 else sizes[i] - lo
                pieces.append((i, lo, n))
                lo, turn = lo + n, turn + 1
                left -= n if left > 0 else 0
        lengths = np.array([n for _, _, n in pieces])
        where, most = differenced(lengths, k)
        if most <= window:
            break
    while most > window:
        k += max(1, (most - window) * k // window)
        where, most = differenced(lengths, k)
    windows: list[list[tuple[int, int, int]]] = [[] for _ in range(k)]
    for piece, w in sorted(zip(pieces, where.tolist(), strict=True)):
        mine = windows[w]
        if mine and mine[-1][0] == piece[0] and mine[-1][1] + mine[-1][2] == piece[1]:  # neighbours become one again
            mine[-1] = (piece[0], mine[-1][1], mine[-1][2] + piece[2])
        else:
            mine.append(piece)
    return out + [w for w in windows if w]


def _packer(path: str, schema: pa.Schema, window: int, group: int):
    encoding: list[tiktoken.Encoding] = []

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding[:] = encoding or [encoder(path)]
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        items: list[tuple] = []
        waiting = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            while rows:
                part = rows[: 1 << 13]
                del rows[: 1 << 13]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

        def dealt() -> None:
            nonlocal sequence
            for pieces in deal([len(ids) for *_, ids in items], window):
                offset = 0
                for i, lo, n in pieces:
                    doc, start, total, ids = items[i]
                    rows.append((doc, start + lo, n, total, sequence, offset, ids[lo : lo + n].tobytes()))
                    offset += n
                sequence += 1
            items.clear()

        for batch in parts:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = token_ids(encoding[0], text)
                n = len(ids)
                whole = n - n % window
                for at in range(0, whole, window):
                    rows.append((doc, at, window, n, sequence, 0, ids[at : at + window].tobytes()))
                    sequence += 1
                if len(rows) >= 1 << 13:
                    yield from flushed()
                if n > whole:
                    items.append((doc, whole, n, ids[whole:].copy()))
                    waiting += n - whole
                if waiting >= group * window:
                    dealt()
                    waiting = 0
                    yield from flushed()
        dealt()
        yield from flushed()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """One row for each piece of a document in a sequence: doc_id, start (its document's ids before it), length, doc_tokens, sequence_id, offset (the sequence's ids before it) and ids (little-endian unsigned, 32 bits).

    A document is the ids of its text and END; null and empty texts are END alone, so every row of docs has a piece. ``window`` is a
    power of two; a sequence holds that many ids, or fewer and padding, or another power of two and none. Null ids stay null, rows
    repeated with one id are packed each, other columns are left out, and an empty table gives no piece. sequence_id is unique, not
    dense. Every task ends with a group of its own, so very many small tasks make more short sequences.
    """
    if window & (window - 1):
        raise ValueError("a window is a power of two")
    id_type = docs.schema[id_col].dataType
    kinds = {"doc_id": id_type, "start": T.LongType(), "length": T.LongType(), "doc_tokens": T.LongType(), "sequence_id": T.LongType(), "offset": T.LongType(), "ids": T.BinaryType()}
    schema = T.StructType([T.StructField(n, t) for n, t in kinds.items()])
    slim = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    return slim.mapInArrow(_packer(tokenizer, pa.schema([(n, to_arrow_type(t)) for n, t in kinds.items()]), window, group), schema)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
