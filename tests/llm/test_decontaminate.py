import random
import re

import pytest
from cases import corpus, frame
from skein.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    out = []
    for doc, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            q = words(t)
            k = min(13, len(q))
            for p in {tuple(q[i : i + k]) for i in range(len(q) - k + 1)} if k else ():
                for i in range(len(w) - k + 1):
                    if tuple(w[i : i + k]) == p:
                        hit.update(range(i, i + k))
                        found.add(str(item))
        out.append((doc, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_bytes", [1 << 20, 300])
def test_against_brute_force(spark, part_bytes):
    rows, r = corpus(3), random.Random(4)
    long = [t.split() for _, t, *_ in rows if t and len(t.split()) > 30]
    items = []
    for i in range(12):
        w = r.choice(long)
        at = r.randrange(len(w) - 20)
        items.append((i, "None-such. " + " ".join(w[at : at + 17]).upper() if i % 3 else " ".join(w[at : at + 4])))
    items += [(20, None), (21, ""), (22, "..."), (23, long[0][0]), (3, "again a"), (2, items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(D.find_benchmark(frame(spark, rows), bench, part_bytes=part_bytes)).collect()
    assert sorted(((x.row.doc_id, x.n_words, x.n_hit, tuple(x["items"]), x.contaminated) for x in got), key=str) == brute(rows, items)
    assert sum(x.n_hit for x in got) > 100


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert all(x.n_hit == 0 for x in D.contamination(D.find_benchmark(frame(spark), bench)).collect())
    assert D.find_benchmark(frame(spark, []), bench, keep_text=False).count() == 0


def test_remove_spans():
    assert words(D.remove_spans("One, two THREE (four) five!", [(1, 3)])) == ["one", "four", "five"]
