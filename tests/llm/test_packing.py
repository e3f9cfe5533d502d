"""Packing against the tokenizer itself: every id in one piece, gapless sequences, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import as_tables, corpus, frame
from tokenizers import Tokenizer

from skein.llm import packing


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def padding(lengths, window=1024):
    return sum(window - n for n in lengths if n & (n - 1))


def test_same_ids_as_the_tokenizer(reference):
    r = random.Random(5)
    alphabet = "ab ' \n\t\r\x0b\x85  ​'sdtI'll1²½éßЖ漢字🙂́!?<|>_-\x00"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["a <|endoftext|> b<|endoftext|>", "x" * 5000, " " * 3000, "it's we'll I'VE", "", None]
    mine = packing.encoder()
    for t in texts:
        assert packing.token_ids(mine, t).tolist() == [*reference.encode(t or "", add_special_tokens=False).ids, 0], t


def check(rows, texts, reference, window=1024):
    """Pieces of each id put together are the ids of its texts, and sequences have no gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in rows:
        assert len(p.ids) == 4 * p.length and p.length > 0
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert set(by_doc) == set(want)
    for i, ps in by_doc.items():
        if len(want[i]) == 1:
            ps.sort(key=lambda p: p.start)
            assert b"".join(p.ids for p in ps) == want[i][0]
            assert [p.start for p in ps] == np.cumsum([0, *[p.length for p in ps]])[:-1].tolist()
            assert {p.doc_tokens for p in ps} == {len(want[i][0]) // 4}
        else:
            assert sum(p.length for p in ps) == sum(map(len, want[i])) // 4
    return [sum(p.length for p in ps) for ps in by_sequence.values()]


def test_pack(spark, reference):
    rows = corpus(2, 120)
    for parts, window, group in ((1, 1024, 512), (7, 1024, 2), (3, 64, 8)):
        found = packing.pack(frame(spark, rows).repartition(parts), window=window, group=group).collect()
        lengths = check(found, [(i, t) for i, t, *_ in rows], reference, window)
        assert padding(lengths, window) <= 0.01 * sum(lengths)


def test_awkward_tables(spark):
    empty = packing.pack(frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    odd = spark.createDataFrame([("k1", None, 1, 2), (None, "", 3, 4), ("k1", None, 1, 2)], "doc_id string, text string, ids int, `a.b` int")
    found = packing.pack(odd.coalesce(1)).collect()
    assert sorted(((p.doc_id, p.start, p.length, p.ids) for p in found), key=str) == sorted([("k1", 0, 1, bytes(4)), (None, 0, 1, bytes(4)), ("k1", 0, 1, bytes(4))], key=str)
    assert padding([sum(p.length for p in found if p.sequence_id == s) for s in {p.sequence_id for p in found}]) == 0
    with pytest.raises(ValueError):
        packing.pack(odd, window=1000)


def test_a_long_document_beside_short_ones(spark, reference):
    r = random.Random(3)
    rows = [(1, " ".join(r.choice(["alpha", "beta", "gam"]) for _ in range(200_000)), "en", "a", 1), *[(i, "word " * r.randint(1, 90), "en", "a", 1) for i in range(2, 300)]]
    lengths = check(packing.pack(frame(spark, rows).coalesce(1)).collect(), [(i, t) for i, t, *_ in rows], reference)
    assert padding(lengths) <= 0.002 * sum(lengths)


def test_windows_are_near_equal():
    r = np.random.default_rng(1)
    for k in (2, 17, 200):
        sizes = r.integers(1, 1024, 4 * k)
        where, most = packing.differenced(sizes, k)
        sums = np.bincount(where, sizes, k)
        assert sums.max() == most and sums.sum() == sizes.sum()
        greedy = np.zeros(k)
        for s in sorted(sizes, reverse=True):
            greedy[greedy.argmin()] += s
        assert sums.max() - sums.min() <= greedy.max() - greedy.min()
    for sizes in ([1023] * 40, [1024] * 3 + [5], [1], [600, 600, 600], [1, 2, 3] * 500):
        dealt = packing.deal(sizes)
        assert all(sum(n for *_, n in s) <= 1024 for s in dealt)
        for i, size in enumerate(sizes):
            cut = sorted((lo, n) for s in dealt for j, lo, n in s if j == i)
            assert [lo for lo, _ in cut] == np.cumsum([0, *[n for _, n in cut]])[:-1].tolist() and sum(n for _, n in cut) == size


def test_count_rises_where_windows_overflow():
    dealt = packing.deal([1023] * 3 + [3], 1024)
    assert max(sum(n for *_, n in s) for s in dealt) <= 1024
    where, most = packing.differenced(np.array([700, 700, 648]), 2)
    assert most > 1024 and packing.differenced(np.array([700, 700, 648]), 3)[1] == 700


def test_query(spark, tmp_path, reference):
    rows = corpus(4, 80)
    sf = as_tables(spark, tmp_path / "t", rows)
    found = packing.op11_packing(spark, sf).collect()
    again = packing.op11_packing(spark, sf).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)
    ids = {i: np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, *_ in rows}
    once = [i for i in ids if sum(1 for r in rows if r[0] == i) == 1]
    for p in found:
        if p.doc_id in once:
            assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids[p.doc_id])
