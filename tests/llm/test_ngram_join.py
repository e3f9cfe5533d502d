from collections import defaultdict

import numpy as np
import pytest
from cases import corpus, frame
from skein.llm import similar
from skein.llm.ngram_join import ngram_join

BIG = (1 << 63) - 1


def near_corpus(seed):
    import random

    r = random.Random(seed)
    rows = corpus(seed, 40)
    n = 100
    for base in [t for _, t, *_ in rows if t and 20 < len(t.split()) < 300][:6]:
        w = base.split()
        for _ in range(7):
            v = list(w)
            for _ in range(r.randint(1, 3)):
                v[r.randrange(len(v))] = f"new{r.randint(0, 9)}"
            rows.append((n, " ".join(v), "en", "a", 1))
            n += 1
    return rows


def brute(rows, threshold=0.8):
    sets = []
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        k = min(5, len(w))
        sets.append((d if d is not None else BIG, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset()))
    n = len(sets)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links, texts = [0] * n, [set() for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = sets[i][1], sets[j][1]
            if i != j and a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                if a != b:
                    texts[i].add(b)
                parent[root(i)] = root(j)
    least, copy = defaultdict(lambda: BIG), defaultdict(lambda: BIG)
    for i, (d, s) in enumerate(sets):
        least[root(i)] = min(least[root(i)], d)
        copy[s] = min(copy[s], d)
    return sorted((d, copy[s] if s else d, least[root(i)], links[i], len(texts[i])) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("group", [2000, 4])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(similar, "GROUP", group)
    rows = near_corpus(8)
    got = ngram_join(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.copy_id, r.class_id, r.n_links, r.n_text_links) for r in got) == brute(rows)
    assert sum(r.n_text_links for r in got) > 40


def test_empty(spark):
    assert ngram_join(frame(spark, [])).count() == 0


def test_components(spark):
    r = np.random.default_rng(2)
    e = [(int(a), int(b)) for a, b in r.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 140)]
    got = {x.id: x.root for x in similar.components(spark.createDataFrame(e, "a long, b long")).collect()}
    label = similar.stars(141, np.array([a for a, _ in e]), np.array([b for _, b in e]))
    assert got == {v: int(label[v]) for v in {x for p in e if p[0] != p[1] for x in p}}


def test_pruning_is_by_the_posterior():
    steps = dict(similar.least_matches(64, 0.8, 1e-3))
    r = np.random.default_rng(3)
    # with a uniform prior, pairs that are dropped reach the threshold about as rarely as the tolerance says
    s = r.random(200_000)
    m = r.binomial(32, s)
    dropped = m < steps[32]
    assert (s[dropped] >= 0.8).mean() < 1e-3 and dropped.mean() > 0.4
