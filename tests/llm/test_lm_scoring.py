import zlib
from collections import Counter

import numpy as np
import pytest
from cases import corpus, frame
from skein.llm import attention as A
from skein.llm.lm_scoring import PIECES, SHARE, TOKENIZER, Subwords, Vocabulary, averaged, lm_score, sequence, sequences, train

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text):
    return [*(text or "").encode().translate(LOWER).split(), b""]


def test_counts_and_base_against_brute_force(spark):
    rows = corpus(9)
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 10 == 0
    c = Counter(w for d, t, *_ in rows if not held(d) for w in tokens(t))
    total, distinct = sum(c.values()), len(c)
    want = sorted(((d, held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), total, sum(np.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens(t))) for d, t, *_ in rows), key=str)
    for block in (1 << 24, 2000):
        got = sorted(lm_score(frame(spark, rows), steps=60, block_bytes=block).collect(), key=lambda r: str((r.doc_id, r.held_out, r.n_tokens)))
        assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [w[:5] for w in want]
        assert np.allclose([r.base_score for r in got], [w[5] for w in want])
        assert all(np.isfinite(r.score) and r.score < 0 for r in got)
        # a known word keeps at least its share of the mixture
        assert all(r.score >= r.base_score + r.n_tokens * np.log10(SHARE) - 1e-6 for r in got if r.n_known == r.n_tokens)
    assert lm_score(frame(spark, [])).count() == 0


@pytest.fixture(scope="module")
def model():
    texts = [(t or "").encode() for _, t, *_ in corpus(9)]
    return train(texts, Subwords(TOKENIZER), 40)


def test_every_unit_is_scored_once_with_its_context(model):
    r = np.random.default_rng(0)
    lengths = np.array([1, 5, 32, 33, 56, 57, 200])
    seq = r.integers(0, model.units.n, lengths.sum())
    logp, logb = model.score(seq, lengths)
    at = 0
    for n in lengths:
        text = seq[at : at + n]
        for i in range(n):  # one window for each unit
            k = 0 if i < A.WINDOW else (i - A.OVERLAP) // (A.WINDOW - A.OVERLAP)
            b = k * (A.WINDOW - A.OVERLAP)
            before = [model.units.n if j == 0 else text[j - 1] for j in range(b, i + 1)]
            z = model.hidden(np.array([before + [0] * (A.WINDOW - len(before))]))[0, i - b][None]
            p, q, _ = model.log_probs(z, text[i : i + 1])
            assert np.isclose(p[0], logp[at + i], atol=1e-3) and np.isclose(q[0], logb[at + i], atol=1e-3)
        at += n


def test_every_unit_is_scored_from_half_a_window(model):
    """The score of each unit depends on the units up to half a window before it, in every window of a long text."""
    r = np.random.default_rng(3)
    seq = r.integers(0, model.units.n, 150)
    old = model.score(seq, np.array([150]))[0]
    for back in (5, 8, 16):
        for i in range(back, 150, 3):
            other = seq.copy()
            other[i - back] = (seq[i - back] + 777) % model.units.n
            assert model.score(other, np.array([150]))[0][i] != old[i], (back, i)


def test_units_sum_to_one(model):
    z = model.hidden(np.zeros((1, A.WINDOW), np.int64))[0, 3:4]
    logp, logb, _ = model.log_probs(np.repeat(z, model.units.n, 0), np.arange(model.units.n))
    u = model.units
    p = np.exp(logp.astype(float))
    p[[u.rare_begin, u.rare_inner]] *= u.vocabulary
    assert np.isclose(p.sum(), 1, atol=1e-3) and np.isclose(p[: u.begin_classes * A.CLASS].sum(), np.exp(logb[0]), atol=1e-3)


def test_gradients(model):
    m = A.Model(model.units)
    for n in m.p:
        m.p[n] = m.p[n].astype(np.float64)
    m.p["h2"] += 0.1 * np.random.default_rng(5).standard_normal(m.p["h2"].shape)
    r = np.random.default_rng(4)
    inputs, targets = r.integers(0, m.units.n, (3, A.WINDOW)), r.integers(0, m.units.n, (3, A.WINDOW))
    valid = r.random((3, A.WINDOW)) < 0.8
    _, grads = m.step(inputs, targets, valid)
    mean = lambda: -float(m.log_probs(m.hidden(inputs).reshape(-1, A.DIM)[np.flatnonzero(valid.ravel())], targets.ravel()[valid.ravel()])[0].mean(dtype=np.float64))
    for n, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = m.p[n][at], 1e-2
        m.p[n][at] = old + e
        up = mean()
        m.p[n][at] = old - e
        down = mean()
        m.p[n][at] = old
        assert np.isclose((up - down) / (2 * e), g[at], rtol=0.05, atol=2e-4), n


def test_attention_beats_its_unigram():
    """Bits for each subword of held-out texts: at least 1.5 fewer than by the counts of the same units."""
    import duckdb

    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    subwords = Subwords(TOKENIZER)
    m = train([t.encode() for d, t in docs if not held(d)], subwords, 500)
    units = lambda keep: [sequence(t.encode(), m.units, subwords) for d, t in docs if keep(d)]
    learned, new = np.concatenate(units(lambda d: not held(d))), units(held)
    flat, lengths = np.concatenate(new), np.array([len(x) for x in new])
    counts = np.bincount(learned, minlength=m.units.n) + 1.0
    rare = np.isin(flat, [m.units.rare_begin, m.units.rare_inner])
    unigram = -(np.log2(counts[flat] / counts.sum()) - rare * np.log2(m.units.vocabulary)).mean()
    model = -m.score(flat, lengths)[0].mean() / np.log(2)
    print(f"unigram {unigram:.3f}, model {model:.3f} bits")
    assert model < unigram - 1.5


def test_beats_the_base_on_held_out_prose(spark):
    got = lm_score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_the_model_learns_from_long_documents(spark):
    """What only a document of over 64 KB shows, an order of words, is learned."""
    rows = [(i, "plain words of short texts %d" % i, "en", "a", 1) for i in range(1, 40)] + [(41, "qzj xvw " * 10_000, "en", "a", 1)]
    assert zlib.crc32(b"41") % 10
    got = {r.doc_id: r for r in lm_score(frame(spark, rows), steps=200).collect()}
    # by counts alone a word of two has 0.4 * 0.5 of the mixture: -0.7
    assert got[41].score / got[41].n_tokens > -0.4


def test_rare_units_are_spelled_by_their_counts():
    counts = np.array([0, 5, 9, 3, 0, 1])
    u = A.Units(counts, counts[::-1], 6, most=2)
    ids = np.arange(6)
    for first, c in ((True, counts), (False, counts[::-1])):
        unit, extra = u.of(ids, np.full(6, first)), u.spelling(ids, np.full(6, first))
        rare = unit == (u.rare_begin if first else u.rare_inner)
        assert rare.sum() == 4 and not extra[~rare].any()
        p = np.exp(extra[rare]) / 6
        assert np.isclose(p.sum(), 1) and p[c[rare] == 3] > p[c[rare] == 0].max()


def test_parameters_are_averaged_by_units_in_a_tree(spark):
    """Means of 300 tasks over groups of FAN: each piece is the mean weighted by units, however many tasks there are."""
    r = np.random.default_rng(6)
    for tasks in (1, 5, 300):
        values, units = r.standard_normal((tasks, 3, 4)).astype(np.float32), r.integers(1, 50, tasks)
        rows = [(p, t, int(units[t]), values[t, p].tobytes()) for t in range(tasks) for p in range(3)]
        got = {x.piece: (x.units, np.frombuffer(x["values"], np.float32)) for x in averaged(spark.createDataFrame(rows, PIECES), tasks).collect()}
        assert sorted(got) == [0, 1, 2]
        for p, (n, x) in got.items():
            assert n == units.sum() and np.allclose(x, (values[:, p] * units[:, None]).sum(0) / units.sum(), atol=1e-4)


def test_each_training_unit_is_predicted_once_a_pass(model):
    texts = [np.arange(n) % 50 for n in (3, 40, 700)]
    for passes in (1, 3):
        losses, units = A.Model(model.units).fit(texts, 0, batch=4, passes=passes)
        # windows: 1 + 2 + 22
        assert units == 743 and len(losses) == passes * 7


def test_a_learner_tokenizes_each_word_once(model, monkeypatch):
    """The units of texts by their words are those of each text alone, and no word is tokenized again."""
    texts = [(t or "").encode() for _, t, *_ in corpus(9)] * 3 + [b"", b"again " * 400]
    subwords, asked = Subwords(TOKENIZER), Counter()
    want = [sequence(t, model.units, subwords).tolist() for t in texts]
    ids = subwords.ids
    monkeypatch.setattr(subwords, "ids", lambda words: asked.update(words) or ids(words))
    for together in (150_000, 30, 0):
        asked.clear()
        got = [x.tolist() for x in sequences(texts, Vocabulary(model, subwords), together)]
        assert got == want
        assert asked and max(asked.values()) == 1
    assert list(sequences([], Vocabulary(model, subwords))) == []


def test_a_step_needs_no_new_gradients(model):
    """Gradients in arrays that an earlier step has filled are those in fresh ones."""
    r, used = np.random.default_rng(7), {n: np.full_like(v, 3) for n, v in model.p.items()}
    for valid in (np.ones((4, A.WINDOW), bool), r.random((4, A.WINDOW)) < 0.7):
        inputs, targets = r.integers(0, model.units.n, (4, A.WINDOW)), r.integers(0, 90, (4, A.WINDOW))
        loss, fresh = model.step(inputs, targets, valid)
        again, same = model.step(inputs, targets, valid, used)
        assert loss == again and same is used
        for n in fresh:
            assert np.allclose(fresh[n], used[n], atol=1e-7), n
