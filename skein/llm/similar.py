"""Jaccard links between sets of shingles: MinHash bands, distributed components, exact verification.

Sets are named by a 64-bit hash. Rows (band value, set) travel packed by shares of the band values and are sorted there; they give
edges to the smallest set of each bucket, so a bucket of any size makes as many edges as it has sets. Candidate components of these edges are found by alternating star
steps on DataFrames; then the shingles of each component travel once, to one task, or, beyond GROUP sets, to one task for each
pair of its blocks. There pairs are pruned by their MinHash values (by the posterior, see least_matches) and the rest are
verified exactly. Tasks send on only counts of links and stars of linked sets, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import kernels as K
from skein.llm.common import batches, bytes_of, column_np, discard, written

#: Sets of one component that meet in a task; beyond, blocks of about half as many.
GROUP = 2000
STEP, TOLERANCE = 16, 1e-7
#: Rows (band value, set): about how many a share has, how many a task gathers before it sends them, and how many it sorts at once.
SHARE, GATHER, MOST = 1 << 18, 1 << 20, 1 << 22
#: Bytes of a band value that travel; its share stands for others. Values that are equal in these by chance only make a candidate more.
BAND = 5
#: Cells of the incidence by which few sets are compared at once; larger sets are compared pair by pair.
WIDE = 1 << 21
#: Bytes of small components that are unpacked at a time.
TOGETHER = 1 << 18


def hash_params(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def signatures(shingles: np.ndarray, starts: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """n MinHash values of each set; sets are non-empty stretches of ``shingles`` that begin at ``starts``."""
    out = np.empty((len(starts), n), np.uint32)
    if not len(starts):
        return out
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for k, (a, b) in enumerate(zip(*hash_params(n, seed), strict=True)):
        x = (low ^ b) * a
        x ^= x >> np.uint32(15)
        x = (x + high) * np.uint32(0x85EBCA6B)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def one_pass_signatures(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n values of each set by one-permutation MinHash: the least hash in each of n bins, an empty bin taking that of the next full one.

    Each shingle, itself a scrambled 64-bit hash, is looked at once and not n times. For sets of a few times n shingles; smaller ones leave too many bins empty.
    """
    none = np.uint64((1 << 64) - 1)
    out = np.full(len(starts) * n, none)
    home = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(shingles))))
    np.minimum.at(out, home * n + (((shingles >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64), shingles & np.uint64(0xFFFFFFFF))
    out = out.reshape(-1, n)
    full, filled = out != none, out.copy()
    open_ = ~full
    for d in range(1, n):
        if not open_.any():
            break
        take = open_ & np.roll(full, -d, 1)
        filled[take] = np.roll(out, -d, 1)[take] + np.uint64(d << 32)
        open_ &= ~take
    return filled


def band_values(sig: np.ndarray, rows: int, first: int = 1) -> np.ndarray:
    """One 64-bit value for each band of ``rows`` MinHash values; different bands never share values but by chance. Bands count from ``first``."""
    n, bands = len(sig), sig.shape[1] // rows
    x = np.broadcast_to(np.arange(first, first + bands, dtype=np.uint64), (n, bands)).copy()
    for k in range(rows):
        x = K.mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, k : bands * rows : rows])
    return x


@lru_cache
def least_matches(hashes: int, threshold: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(h, m): after h compared values a pair with fewer than m matches is dropped.

    With a uniform prior the similarity of a pair with m matches is Beta(m + 1, h - m + 1), and it reaches the threshold t
    with the probability that at most m of h + 1 tosses of chance t succeed; below the tolerance the pair is dropped.
    """
    out = []
    for h in range(STEP, hashes + 1, STEP):
        total, m = 0.0, 0
        while m <= h:
            total += comb(h + 1, m) * threshold**m * (1 - threshold) ** (h + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append((h, m))
    return out


def _packed(make: Callable, shares: int) -> Callable:
    """The (band, id) that ``make`` gives, as bytes: one row for each share of the band values and GATHER of them."""
    schema = pa.schema([("share", pa.int64()), ("bands", pa.binary()), ("ids", pa.binary())])

    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        band, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        share = (((band.view(np.uint64) >> np.uint64(32)) * np.uint64(shares)) >> np.uint64(32)).astype(np.uint16 if shares <= 1 << 16 else np.uint32)
        order = np.argsort(share, kind="stable")
        band, ids, share = band[order], ids[order], share[order]
        edges = [*np.flatnonzero(np.diff(share, prepend=share[0])).tolist(), len(share)]
        cuts = list(zip([0, *edges[:-1]], edges, strict=True))
        yield from batches(schema, [[int(share[lo]) for lo, _ in cuts], [band[lo:hi].tobytes() for lo, hi in cuts], [ids[lo:hi].tobytes() for lo, hi in cuts]])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in make(parts):
            held.append((column_np(batch, "band"), column_np(batch, "id")))
            size += len(batch)
            if size >= GATHER:
                yield from send(held)
                held, size = [], 0
        if size:
            yield from send(held)

    return run


def _narrow(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _packed() gives, with BAND bytes of each band value."""
    for batch in parts:
        bands = [np.frombuffer(x, np.uint8).reshape(-1, 8)[:, :BAND].tobytes() for x in bytes_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bands, pa.binary()), batch.column(2)], schema=batch.schema)


def _wide(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Eight bytes again, the others 0."""
    for batch in parts:
        bands = []
        for x in bytes_of(batch.column(1)):
            out = np.zeros((len(x) // BAND, 8), np.uint8)
            out[:, :BAND] = np.frombuffer(x, np.uint8).reshape(-1, BAND)
            bands.append(out.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bands, pa.binary()), batch.column(2)], names=["share", "bands", "ids"])


def _edges(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the buckets of each share, in any order of rows; where a share has over MOST rows its bands keep their smallest set from piece to piece."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> Iterator[pa.RecordBatch]:
        band, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(band)
        band, ids = band[order], ids[order]
        start = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
        least = np.minimum.reduceat(ids, start)
        lead = np.repeat(least, np.diff(np.append(start, len(ids))))
        held[:] = [(band[start], least)]
        other = np.flatnonzero(ids != lead)
        a, b = ids[other], lead[other]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        yield from batches(schema, [a[new], b[new]])

    share, size = None, 0
    for batch in parts:
        for s, band, ids in zip(column_np(batch, "share").tolist(), bytes_of(batch.column(1)), bytes_of(batch.column(2)), strict=True):
            if held and (s != share or size > MOST):
                yield from settle()
                size = 0
                if s != share:
                    held.clear()
            share = s
            held.append((np.frombuffer(band, np.int64), np.frombuffer(ids, np.int64)))
            size += len(held[-1][0])
    if held:
        yield from settle()


def bucket_edges(rows: DataFrame, make: Callable, expected: int) -> DataFrame:
    """Edges (a, b), a > b, that connect the sets of each bucket to its smallest one.

    make: from batches of rows to batches of (band, id), repeats allowed; expected: about how many of them there are.
    """
    pack = _packed(make, max(1, -(-expected // SHARE)))
    sent = rows.mapInArrow(lambda parts: _narrow(pack(parts)), "share long, bands binary, ids binary")
    return sent.repartition("share").sortWithinPartitions("share").mapInArrow(lambda parts: _edges(_wide(parts)), "a long, b long").distinct()


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, root): the smallest member of each vertex's component, for all vertices of edges (a, b).

    Union-find as alternating star steps: every vertex links its larger neighbours, then its smaller ones, to the smallest
    vertex it knows, until all components are stars; edges only move to smaller vertices, so this ends. Each round is written
    to the shared folder, and the one before it goes.
    """

    def large(e: DataFrame) -> DataFrame:
        s = e.union(e.select("b", "a")).toDF("u", "v")
        m = s.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        return s.where("v > u").join(m, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        m = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("w"), "m")
        j = e.join(m, F.col("a") == F.col("w"))
        return j.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(m.select(F.col("w").alias("a"), F.col("m").alias("b"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    e, path = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), name)
    seen, settled = mark(e), False
    while seen[0] and not settled:
        before = path
        e, path = written(small(large(e)), name)
        discard(e.sparkSession, before)
        now = mark(e)
        seen, settled = now, now == seen
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).union(e.select("b", "b")).distinct()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many members two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return np.count_nonzero(y[at] == x)


def linked_pairs(sets: list[np.ndarray], hashes: int, threshold: float, split: int | None = None, few: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all pairs of sets (sorted, unique, non-empty) with Jaccard similarity of at least the threshold.

    split: only pairs of one of the first ``split`` sets and one of the others. few: so many sets are compared exactly at once,
    without their MinHash values.
    """
    n = len(sets)
    if split is None and n <= few:
        size = np.array([len(s) for s in sets], np.int64)
        i, j = np.triu_indices(n, 1)
        near = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
        i, j = i[near], j[near]
        if len(i) > 1 and n * size.sum() <= WIDE:
            # all intersections as one product of the sets' incidence with itself
            _, at = np.unique(np.concatenate(sets), return_inverse=True)
            has = np.zeros((n, int(at.max()) + 1), np.float32)
            has[np.repeat(np.arange(n), size), at] = 1
            common = (has @ has.T)[i, j].astype(np.int64)
        else:
            common = np.array([_common(sets[x], sets[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
        hit = common >= threshold * (size[i] + size[j] - common) - 1e-9
        return i[hit], j[hit]
    size = np.array([len(s) for s in sets], np.int64)
    start = np.cumsum(size) - size
    flat = np.concatenate(sets)
    sig = np.concatenate([signatures(flat[start[i] : start[j - 1] + size[j - 1]], start[i:j] - start[i], hashes) for i in range(0, n, 256) for j in [min(n, i + 256)]])
    steps, found = least_matches(hashes, threshold), []
    rows = 128
    for i in range(0, split if split is not None else n, rows):
        j = min(i + rows, split if split is not None else n)
        base = i + 1 if split is None else split
        near = np.zeros((j - i, n - base), np.uint8)
        for k in range(STEP):
            near += sig[i:j, k][:, None] == sig[base:, k][None, :]
        a, b = np.nonzero(near >= steps[0][1])
        a, b = a + i, b + base
        ok = (a < b) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]))
        a, b = a[ok], b[ok]
        same = near[a - i, b - base].astype(np.int32)
        for h, m in steps[1:]:
            same = same + (sig[a, h - STEP : h] == sig[b, h - STEP : h]).sum(1)
            ok = same >= m
            a, b, same = a[ok], b[ok], same[ok]
        found.append((a, b))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    common = intersections(flat, start, size, a, b)
    ok = common >= threshold * (size[a] + size[b] - common) - 1e-9
    return a[ok], b[ok]


def intersections(flat: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets a and b, pair by pair, in blocks of pairs."""
    out = np.empty(len(a), np.int64)
    if not len(a):
        return out
    _, ids = np.unique(flat, return_inverse=True)
    mark, order = np.zeros(int(ids.max()) + 1, bool), np.argsort(a, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        # one set against all its partners: mark its members, then count marks over the partners' stretches
        own, other = a[group[0]], b[group]
        mark[ids[start[own] : start[own] + size[own]]] = True
        for at in range(0, len(other), 512):
            o = other[at : at + 512]
            head = np.cumsum(size[o]) - size[o]
            take = np.repeat(start[o] - head, size[o]) + np.arange(size[o].sum())
            out[group[at : at + 512]] = np.add.reduceat(mark[ids[take]], head, dtype=np.int64)
        mark[ids[start[own] : start[own] + size[own]]] = False
    return out


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n vertices reaches over the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: body: a set's sorted shingles as bytes, or whatever ``unpack`` makes them from.
SETS = "root long, id long, weight long, body binary"
OUT = "id long, root long, links long, linked long"
OUT_ARROW = pa.schema([(c, pa.int64()) for c in ("id", "root", "links", "linked")])


def as_shingles(bodies: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in bodies]


def verify(sets: DataFrame, hashes: int, threshold: float, size_of: DataFrame, unpack: Callable[[list[bytes]], list[np.ndarray]] = as_shingles, few: int = 0) -> DataFrame:
    """Rows (id, root, links, linked): stars of linked sets, and in each how many sets, and weights of sets, an id links to.

    sets: SETS, with the candidate component in root; size_of: (root, members). An id may have several rows: their links add
    up, and their roots are edges. Repeated rows of one id count once.
    """
    small = sets.join(size_of.where(F.col("members") <= GROUP).select("root"), "root").withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)})
    large = sets.join(size_of.where(F.col("members") > GROUP), "root")
    n = F.ceil(F.col("members") / (GROUP // 2)).cast("int")
    own = F.pmod(F.xxhash64("id"), n).cast("int")
    large = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    large = large.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    cols = ["root", "i", "j", "side", "id", "weight", "body"]
    work = small.select(cols).unionByName(large.select(cols))
    return work.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "id").mapInArrow(_verified(hashes, threshold, unpack, few), OUT)


def _verified(hashes: int, threshold: float, unpack: Callable, few: int) -> Callable:
    def settle(groups: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        """Groups that are unpacked together, so that small ones cost little each."""
        sets, out = unpack([r[6] for g in groups for r in g]), []
        at = 0
        for g in groups:
            own, at = sets[at : at + len(g)], at + len(g)
            split = sum(1 - r[3] for r in g) if g[0][1] != g[0][2] else None
            if split in (0, len(g)):
                continue
            a, b = linked_pairs(own, hashes, threshold, split, few)
            if not len(a):
                continue
            ids, weight = np.array([r[4] for r in g]), np.array([r[5] for r in g], np.int64)
            links = np.bincount(a, minlength=len(g)) + np.bincount(b, minlength=len(g))
            linked = np.bincount(a, weights=weight[b], minlength=len(g)) + np.bincount(b, weights=weight[a], minlength=len(g))
            go = np.flatnonzero(links)
            out.append((ids[go], ids[stars(len(g), a, b)[go]], links[go], linked[go].astype(np.int64)))
        if out:
            yield from batches(OUT_ARROW, [np.concatenate(c) for c in zip(*out, strict=True)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        waiting: list[list[tuple]] = []
        size = 0
        for batch in parts:
            for r in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if rows and r[:3] != rows[-1][:3]:
                    if len(rows) > 1:
                        waiting.append(rows)
                    rows = []
                    if size > TOGETHER:
                        yield from settle(waiting)
                        waiting, size = [], 0
                if not rows or r[4] != rows[-1][4]:
                    rows.append(r)
                    size += len(r[6])
        yield from settle([*waiting, rows] if len(rows) > 1 else waiting)

    return run
