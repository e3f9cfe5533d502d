"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import oracle
import pytest
from cases import as_tables, corpus, frame

from skein.llm import spelling


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for c in letters:
        out |= {word[:i] + c + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1)}
    return out - {word}


def brute(words):
    """{word: (form, root, n, n_near, form_n)}"""
    letters = sorted({c for w in words for c in w})
    out = {}
    for w, n in words.items():
        near = [x for x in edits(w, letters) if x in words]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 10 * n else None
        out[w] = (form, n, len(near), words[form] if form else None)

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return {w: (f, root(w), n, k, fn) for w, (f, n, k, fn) in out.items()}


def vocabulary(seed, n, letters="abcdé", sizes=(7, 12)):
    """Words that often are an edit or two from each other, some of one letter alone, and long ones."""
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(*sizes))) for _ in range(n // 4)]
    words += ["a" * k for k in range(7, 16)] + ["ab" * k for k in range(4, 9)] + ["x" * 900, "x" * 901, "x" * 450 + "y" + "x" * 449]
    while len(words) < n:
        words.append(r.choice(sorted(edits(r.choice(words[: n // 2]), letters))))
    return {w: r.choice([2, 3, 5, 30, 45, 400, 5000, 70_000]) for w in words if len(w) >= 7}


@pytest.mark.parametrize("hot,letters_at_once", [(200_000, 1 << 21), (3, 300), (0, 1 << 21)])
def test_against_all_pairs(spark, monkeypatch, hot, letters_at_once):
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "LETTERS_AT_ONCE", letters_at_once)
    words = vocabulary(hot, 700)
    if hot == 0:
        words = {w: n for w, n in words.items() if len(w) < 100}
    got = spelling.variants(spark.createDataFrame(sorted(words.items()), "word string, n long").repartition(5)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute(words) and len(got) == len(words)


def test_chains_of_forms(spark):
    words = {"aaaaaaa" + "b" * i: 10 ** (18 - i) for i in range(17)} | {"aaaaaaac": 10**17}
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(sorted(words.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"aaaaaaa"}


def test_awkward_words(spark):
    empty = spelling.variants(spark.createDataFrame([], "word string, n long"))
    assert empty.collect() == []
    for bad in ("short", "ōōōōōōōōō"):
        with pytest.raises(Exception):  # noqa: B017
            spelling.variants(spark.createDataFrame([(bad, 2)], "word string, n long")).collect()
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([("abcdefgh", 2)], "word string, n long"), times=1)


def words_of(rows):
    count = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def test_query_over_awkward_documents(spark, tmp_path):
    rows = corpus(6, 90) + [(1000 + i, t, "en", "a", 1) for i, t in enumerate(["THE×QUICKEST÷word ÀÉÎõü_ÿÿÿÿÿÿÿ1abcdefg", "Abcdefgh " * 60, "x" * 1_200_000, "x" * 1_200_000, None])]
    assert spelling.counted(frame(spark, [])).collect() == []
    want = words_of(rows)
    assert {r.word: r.n for r in spelling.counted(frame(spark, rows)).collect()} == want
    rows = [r for r in rows if r[1] is None or len(r[1]) < 100_000]
    sf = as_tables(spark, tmp_path / "t", rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    assert oracle.differences(spelling.op13_spelling(spark, sf), con, spelling.OP13_SQL) == []
    got = spelling.op13_spelling(spark, sf).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute(words_of(rows))
