"""Numpy kernels over sequences: substring hashes, window anchors and suffix order."""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Sequences are cut into overlapping pieces of this length, so that very long texts need no more memory.
PIECE = 1 << 20
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((BASE, INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


def byte_values(data: np.ndarray) -> np.ndarray:
    """Bytes as 64-bit values to hash."""
    return _BYTE[data]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which span_hash takes the hash of any span."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal for equal contents, wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def word_spans(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no separators (a table of 256 booleans)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separator[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def separators(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


BLANK_BYTES = separators(b" \t\n\x0b\f\r")


def word_hashes(data: np.ndarray, separator: np.ndarray = BLANK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a text; long texts are hashed piece by piece."""
    starts, ends = word_spans(data, separator)
    if len(data) <= PIECE:
        return starts, ends, span_hash(prefix_sums(byte_values(data)), starts, ends)
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        upto = max(done + 1, int(np.searchsorted(ends, starts[done] + PIECE, "right")))
        lo, hi = int(starts[done]), int(ends[upto - 1])
        out[done:upto] = span_hash(prefix_sums(byte_values(data[lo:hi])), starts[done:upto] - lo, ends[done:upto] - lo)
        done = upto
    return starts, ends, out


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    at = np.arange(n)
    return span_hash(prefix_sums(values), at, at + k)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by running minima from both sides of blocks of w."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, x.max(), x.dtype)]) if pad else x
    blocks = y.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(values: np.ndarray, k: int, w: int) -> tuple[np.ndarray, ...]:
    """One row for each anchor: (key, context, lo, hi, at).

    Every window of L = k + w - 1 values has one anchor, the leftmost of its k-grams with the smallest hash, so equal
    windows have equal anchors at equal offsets. Windows that start in [lo, hi] have their anchor at ``at``; key hashes the
    k-gram and context the values [lo, hi + L) with the anchor's place in them.
    """
    length, parts = k + w - 1, []
    for base in range(0, max(0, len(values) - length + 1), PIECE):
        part = values[base : base + PIECE + length - 1]
        if len(part) < length:
            break
        sums = prefix_sums(part)
        at = np.arange(len(part) - k + 1)
        grams = span_hash(sums, at, at + k)
        low = sliding_min((grams & np.uint64(MASK ^ 0xFFFFFF)) | at.astype(np.uint64), w)
        place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        lo = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        hi = np.concatenate([lo[1:] - 1, [len(place) - 1]])
        place = place[lo]
        context = mix(span_hash(sums, lo, hi + length) ^ ((hi - lo) * 1000003 + (place - lo) + 1).astype(np.uint64))
        parts.append((grams[place], context, lo + base, hi + base, place + base))
    if not parts:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    step = np.empty(len(keys), np.int64)
    if len(keys):
        step[0] = 0
        np.cumsum(keys[order][1:] != keys[order][:-1], out=step[1:])
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = step
    return order, ranks


def suffix_order(symbols: np.ndarray, length: int, have: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``length`` elements, and each position's rank among those prefixes.

    Prefix doubling: ranks of prefixes of 1, 2, 4, ... elements; the last step joins two overlapping prefixes, so that
    exactly ``length`` count. A suffix that is shorter is as if followed by elements below all others. ``have``: how many
    elements each symbol already covers.
    """
    order, ranks = _ranks(symbols if symbols.dtype == np.uint64 else symbols.astype(np.int64))
    n = len(symbols)
    while have < length and n:
        step = min(have, length - have)
        if ranks[order[-1]] == n - 1:
            break
        after = np.zeros(n, np.int64)
        if step < n:
            after[: n - step] = ranks[step:] + 1
        order, ranks = _ranks(ranks * (n + 1) + after)
        have += step
    return order, ranks


def pack_bytes(data: np.ndarray) -> np.ndarray:
    """Each position's next seven bytes as one number that sorts as they do; 0 stands past the end, bytes count from 1."""
    wide, out = np.concatenate([data.astype(np.int64) + 1, np.zeros(6, np.int64)]), np.zeros(len(data), np.int64)
    for k in range(7):
        out = out * 257 + wide[k : k + len(data)]
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray, rest: np.ndarray, step: int = 16) -> np.ndarray:
    """The LCP array: how many elements each suffix shares with the one before it in order, of which only ``rest`` may be used; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    most = np.minimum(rest[a], rest[b])
    open_, done = np.flatnonzero(most > 0), 0
    while len(open_):
        at = done + np.arange(step)
        x, y = a[open_, None] + at, b[open_, None] + at
        same = (data[np.minimum(x, len(data) - 1)] == data[np.minimum(y, len(data) - 1)]) & (at < most[open_, None])
        run = np.where(same.all(1), step, same.argmin(1))
        out[open_ + 1] += run
        open_ = open_[run == step]
        done += step
    return out


def previous_smaller(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier place with a smaller value, not before ``first`` of it; -1 if there is none."""
    p = np.arange(len(x)) - 1
    p[p < first] = -1
    open_ = np.flatnonzero(p >= 0)
    while len(open_):
        open_ = open_[x[p[open_]] >= x[open_]]
        p[open_] = p[p[open_]]
        open_ = open_[p[open_] >= first[open_]]
    p[p < first] = -1
    return p


def previous_factors(order: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each position's first ``length`` elements (those that ranks tell apart) also start earlier, and later.

    These are the longest-previous-factor and longest-next-factor arrays against that length: the previous and the next
    place in suffix order with a smaller (or larger) position bound the longest match, and a match reaches the length where
    that place is in the same run of ranks.
    """
    n = len(order)
    earlier, later = np.zeros(n, bool), np.zeros(n, bool)
    if not n:
        return earlier, later
    r = ranks[order]
    edge = np.concatenate([[True], r[1:] != r[:-1], [True]])
    at = np.flatnonzero(~(edge[:-1] & edge[1:]))  # members of runs of two or more
    if not len(at):
        return earlier, later
    x, run = order[at], np.cumsum(edge[:-1])[at]
    begin = np.concatenate([[True], run[1:] != run[:-1]])
    first = np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
    end = np.concatenate([begin[1:], [True]])
    back = np.maximum.accumulate(np.where(end[::-1], np.arange(len(at)), 0))
    for out, y in ((earlier, x), (later, -x)):
        psv = previous_smaller(y, first)
        nsv = previous_smaller(y[::-1], back)[::-1]
        out[x] = (psv >= 0) | (nsv >= 0)
    return earlier, later


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals as disjoint maximal ones."""
    if len(starts) == 0:
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    at = np.flatnonzero(new)
    return s[at], e[np.concatenate([at[1:] - 1, [len(s) - 1]])]
