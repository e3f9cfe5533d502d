from collections import defaultdict

import numpy as np
import pytest
from cases import corpus, frame
from skein.llm import kernels as K
from skein.llm import repeats
from skein.llm.substring_dedup import dedup_words
from skein.llm.suffix_dedup import dedup_substrings


def test_suffix_order_and_previous_factors():
    r = np.random.default_rng(0)
    for _ in range(60):
        s, length = bytes(r.integers(97, 99, r.integers(1, 60)).astype(np.uint8)), int(r.integers(1, 9))
        data = np.frombuffer(s, np.uint8)
        pre = [s[i : i + length] for i in range(len(s))]
        for order, ranks in (K.suffix_order(data, length), K.suffix_order(K.pack_bytes(data), max(7, length), 7)):
            long = max(7, length) if order is None else length
            assert [pre[i] for i in order] == sorted(pre)
        order, ranks = K.suffix_order(data, length)
        earlier, later = K.previous_factors(order, ranks)
        assert earlier.tolist() == [pre[i] in pre[:i] for i in range(len(s))]
        assert later.tolist() == [pre[i] in pre[i + 1 :] for i in range(len(s))]


def test_anchors_cover_all_windows_alike():
    r = np.random.default_rng(1)
    v = r.integers(0, 3, 400).astype(np.uint64)
    v[200:260] = v[20:80]
    key, ctx, lo, hi, at = K.anchors(K.mix(v), 6, 5)
    assert lo[0] == 0 and (lo[1:] == hi[:-1] + 1).all() and hi[-1] == 400 - 10
    owner = {i: (k, a - i) for k, a, x, y in zip(key, at, lo, hi) for i in range(x, y + 1)}
    assert all(owner[20 + i] == owner[200 + i] for i in range(51))


def brute_bytes(rows, length, keep):
    at = defaultdict(list)
    texts = [(d if d is not None else 1 << 62, (t or "").encode()) for d, t, *_ in rows]
    for n, (d, t) in enumerate(texts):
        for i in range(len(t) - length + 1):
            at[t[i : i + length]].append((d, n, i))
    out = []
    for n, (d, t) in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if len(at[t[i : i + length]]) > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((d, len(t), int(gone.sum()), int((edge == 1).sum()), bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,group", [(200, 4000), (20, 4000), (20, 1)])
def test_bytes_against_brute_force(spark, monkeypatch, length, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = corpus(5)
    got = dedup_substrings(frame(spark, rows), length, "none").collect()
    assert sorted(((r.doc_id if r.doc_id is not None else 1 << 62, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute_bytes(rows, length, "none")


def test_bytes_keep_first(spark):
    rows = [(1, "abcdefghij" * 4, "en", "a", 40), (2, "xx" + "abcdefghij" * 4 + "yy", "en", "a", 44)]
    got = {r.doc_id: bytes(r.kept) for r in dedup_substrings(frame(spark, rows), 20, "first").collect()}
    assert got == {1: b"abcdefghij", 2: b"xxyy"}


def brute_words(rows, window):
    least = {}
    texts = [(d if d is not None else 1 << 62, (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in texts:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(d, least.get(k, d))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,group", [(50, 4000), (6, 4000), (6, 1)])
def test_words_against_brute_force(spark, monkeypatch, window, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = corpus(6)
    got = dedup_words(frame(spark, rows), window).collect()
    assert sorted(((r.doc_id if r.doc_id is not None else 1 << 62, r.n_words, r.n_removed, bytes(r.kept)) for r in got), key=str) == brute_words(rows, window)


def test_empty(spark):
    assert dedup_words(frame(spark, [])).count() == 0 and dedup_substrings(frame(spark, [])).count() == 0


def test_common_prefixes_and_deep_nodes():
    r = np.random.default_rng(2)
    for _ in range(60):
        data, doc = r.integers(0, 2, 70), np.sort(r.integers(0, 4, 70))
        rest, depth = 70 - np.arange(70), int(r.integers(1, 9))
        order = K.suffix_order(data, 70)[0]
        prefixes = [0, *(next((k for k in range(min(rest[a], rest[b])) if data[a + k] != data[b + k]), min(rest[a], rest[b])) for a, b in zip(order, order[1:]))]
        assert K.common_prefixes(data, order, rest, 3).tolist() == prefixes
        order = order[rest[order] >= depth]
        windows = {i: tuple(data[i : i + depth]) for i in order}
        least = repeats.smallest_below(data, order, rest, doc, depth)
        assert all(least[i] == min(doc[j] for j in windows if windows[j] == windows[i]) for i in windows)


@pytest.mark.parametrize("keep,words", [("first", False), ("document", True), ("none", False)])
def test_longer_prefixes_say_the_same(spark, monkeypatch, keep, words):
    docs = frame(spark, corpus(7)).selectExpr("coalesce(doc_id, 99) doc_id", "xxhash64(text) th", "cast(coalesce(text, '') as binary) text")
    kind = repeats.Kind(4, 5, keep, words)
    found = []
    for group in (4000, 3, 1):
        monkeypatch.setattr(repeats, "GROUP", group)
        found.append(sorted((r.doc_id, r.th, *(x.tolist() for x in K.merge_spans(*map(np.array, zip(*r.spans))))) for r in repeats.removed_spans(docs, kind).collect()))
    assert found[0] and found[0] == found[1] == found[2]
