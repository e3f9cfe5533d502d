"""Quality and language: held-out accuracy on the given tables, awkward rows, and scores that do not depend on labels or ids."""

import os
import random

import numpy as np
import pytest
from cases import corpus, frame
from pyspark.sql import functions as F

from skein.llm import kernels as K
from skein.llm import language_id, quality
from skein.llm.common import held_out

SF = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

WORDS = {"good": "clear plain ordered steady careful reasoned".split(), "bad": "buybuy clickk winnn freeee hotttt nowww".split()}


def labelled(n=240, seed=4):
    r = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        kind = "good" if i % 2 else "bad"
        rows.append((i, " ".join(r.choice(WORDS[kind]) for _ in range(30)), "en", "a", 1))
        marks.append((i, int(kind == "good")))
    return rows, marks


def by_id(df):
    return sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 9)) for r in df.collect())


def test_quality_learns_and_awkward_rows(spark):
    rows, marks = labelled()
    labels = spark.createDataFrame([*marks, (1, None), (9999, 1)], "doc_id long, quality int")
    model = quality.fit(frame(spark, rows[:160]), labels)
    got = {r.doc_id: r.score for r in quality.score(frame(spark, rows[160:]), model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in marks[160:])
    odd = frame(spark).withColumns({"row": F.lit(1), "score": F.lit("x"), "t": F.lit(2)})
    assert by_id(quality.score(odd, model)) == by_id(quality.score(frame(spark), model))
    scores = {}
    for r in quality.score(odd, model).collect():
        assert 0 <= r.score <= 1
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert len(scores[3]) == 1
    blank = [i for i, t, *_ in corpus() if i is not None and not (t or "").split()]
    assert len({s for i in blank for s in scores[i]}) == 1
    assert quality.score(frame(spark, []), model).count() == 0
    untaught = quality.fit(frame(spark, []), labels)
    assert {round(r.score, 6) for r in quality.score(frame(spark), untaught).collect()} == {0.5}


def test_quality_reads_whole_texts():
    text = b"abc defgh " * 400_000
    assert sum(len(quality.features(text[at])) for at in quality.pieces(text)) >= len(quality.features(b"abc defgh")) * 399_000
    assert quality.pieces(b"") == [slice(0, 0)]
    # the word, that it is new, and <a>
    assert len(quality.features(b" \n ")) == 0 and len(quality.features(b"a")) == 3


def buckets_by_hand(text):
    """Words, pairs of words, recurrences and n-grams, one at a time."""
    top = lambda x: int(x) >> (64 - 17)
    words, out, mask = text.split(), [], (1 << 64) - 1
    hashes = [int(K.word_hashes(np.frombuffer(w, np.uint8))[2][0]) for w in words]
    for i, (w, h) in enumerate(zip(words, hashes)):
        out.append(top(h))
        if i:
            out.append(top(K.mix(np.array([(hashes[i - 1] * 3 + h) & mask], np.uint64))[0]))
        last = max((j for j in range(i) if words[j] == w), default=None)
        gap = 0 if last is None else 1 + (i - last - 1).bit_length()
        out.append(top(K.mix(np.array([gap], np.uint64))[0]))
        marked = b"<" + w + b">"
        for n in (3, 4, 5):
            for at in range(len(marked) - n + 1):
                out.append(top((((int.from_bytes(marked[at : at + n], "big") + (n << 48)) & mask) * 0x9E3779B97F4A7C15) & mask))
    return sorted(out)


def test_scores_by_hand(spark):
    """The score is the mean of the model's numbers over the buckets counted one at a time, plus the bias."""
    model = np.random.default_rng(3).standard_normal(quality.BUCKETS + 1).astype(np.float32)
    rows = [r for r in corpus() if r[0] is not None and len(r[1] or "") < 3000]
    got = {r.doc_id: r.score for r in quality.score(frame(spark, rows), model).collect()}
    for i, text, *_ in rows:
        data = (text or "").encode()
        b = buckets_by_hand(data)
        assert quality.features(data).tolist() is not None and sorted(quality.features(data).tolist()) == b
        z = float(model[-1]) + (float(model[b].sum(dtype=np.float64)) / len(b) if b else 0)
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-6


def test_samples_keep_their_bounds(spark, monkeypatch):
    rows, marks = labelled()
    often = frame(spark, [*rows, *[rows[0]] * 3000, *[(None, t, *x) for _, t, *x in rows]])
    sizes = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: sizes.append(len(texts)))
    quality.fit(often, spark.createDataFrame([*marks, (None, 1)], "doc_id long, quality int"), sample=50)
    monkeypatch.setattr(language_id, "Model", lambda texts, langs: sizes.append(len(texts)))
    many = [(i % 40, f"text number {i % 90}", "en" if i % 3 else "fr", "a", 1) for i in range(4000)]
    language_id.fit(frame(spark, many), per_language=5)
    assert sizes == [50, 10]


def test_ids_of_other_types(spark):
    """Classifiers carry any id; operators that compare ids say that they need whole numbers."""
    from skein.llm.common import ids_and_bytes

    rows, marks = labelled()
    named = frame(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    model = quality.fit(named, spark.createDataFrame([(f"d{i}", y) for i, y in marks], "doc_id string, quality int"))
    assert quality.score(named, model).schema["doc_id"].dataType.simpleString() == "string" and quality.score(named, model).count() == 240
    assert language_id.identify(named, language_id.fit(named)).where("doc_id = 'd3'").count() == 1
    with pytest.raises(TypeError):
        ids_and_bytes(named)
    with pytest.raises(Exception, match="largest long"):
        ids_and_bytes(frame(spark, [((1 << 63) - 1, "x", "en", "a", 1)])).collect()


def test_a_letter_without_a_known_gram(spark):
    model = language_id.Model([b"abc abd", b"xyz xyw"], ["en", "fr"])
    ((best, score),) = [tuple(x) for x in zip(*model.predict(["漢".encode()]))]
    assert (model.langs[best], float(score)) == ("en", 0.5)


@given
def test_quality_held_out(spark):
    found = quality.op2_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    ranks = found.score.rank()
    good = found.quality == 1
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert len(found) > 40 and auc > 0.9
    assert ((found.score >= 0.3) == (found.predicted == 1)).all()


def test_language_awkward_rows(spark):
    model = language_id.fit(frame(spark))
    odd = frame(spark).withColumns({"row": F.lit(1), "l": F.lit(2), "h": F.lit(3), "i": F.lit(4), "t": F.lit(5)})
    got = {}
    for r in language_id.identify(odd, model).collect():
        got.setdefault(r.doc_id, set()).add((r.lang_pred, round(r.score, 6)))
    assert all(len(v) == 1 for v in got.values())
    for i, t, *_ in corpus():
        ((lang, score),) = got[i]
        assert (lang == "und") == (not t or not any(c.isalpha() for c in t)) and 0 <= score <= 1
        assert lang in ("und", "en", "fr")
    assert {(r.lang_pred, r.score) for r in language_id.identify(frame(spark), language_id.fit(frame(spark, []))).collect()} == {("und", 0.0)}
    assert language_id.identify(frame(spark, []), model).count() == 0
    assert language_id.identify(odd, model, carry=True).select("row.*").columns == odd.columns


def test_language_scores_are_the_kernel_regression():
    """The folded matrix gives what the kernel of presence sets, whitened over the landmarks, gives."""
    texts, langs = [b"the old house by the sea", b"of the house", b"la maison de la mer", b"une maison"] * 3, ["en", "en", "fr", "fr"] * 3
    m = language_id.Model(texts, langs, landmarks=2)
    known = np.flatnonzero(m.slot)
    sets = [set(np.concatenate(list(language_id.gram_codes(t))).tolist()) & set(known.tolist()) for t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    chosen = [0, 1, 2, 3]
    kzz = np.array([[kernel(sets[a], sets[b]) for b in chosen] for a in chosen])
    kxz = np.array([[kernel(s, sets[b]) for b in chosen] for s in sets])
    values, vectors = np.linalg.eigh(kzz)
    phi = kxz @ (vectors / np.sqrt(values))
    y = np.array([[1.0 if a == b else -1.0 for b in ("en", "fr")] for a in langs])
    w = np.full((len(texts), 1), 1 / 6)
    want = phi @ np.linalg.solve(phi.T @ (w * phi) + language_id.RIDGE * np.eye(4), phi.T @ (w * y))
    assert np.allclose(m._unit(texts) @ m.weights, want, atol=1e-3)


def test_a_language_of_few_texts_keeps_its_grams():
    r = random.Random(7)
    own = lambda letters: ["".join(r.choice(letters) for _ in range(6)) for _ in range(3000)]
    words = {"l%d" % k: own("abcdefghijklmnopqrstuvwxyz"[k * 5 : k * 5 + 14]) for k in range(3)}
    texts, langs = [], []
    for lang, some in words.items():
        for _ in range(200):
            texts.append(" ".join(r.choice(some) for _ in range(600)).encode())
            langs.append(lang)
    rare = lambda: " ".join("".join(r.choice("აბგდევზთ") for _ in range(5)) for _ in range(20)).encode()
    m = language_id.Model(texts + [rare() for _ in range(6)], langs + ["rare"] * 6)
    held = set(np.flatnonzero(m.slot).tolist())
    firsts = [t for lang in words for t in [t for t, a in zip(texts, langs) if a == lang][:64]]
    assert all(set(np.concatenate(list(language_id.gram_codes(t))).tolist()) <= held for t in firsts)
    best, score = m.predict([rare() for _ in range(20)])
    assert {m.langs[b] for b in best} == {"rare"} and min(score) > 0.5


def test_a_language_of_long_texts_alone_is_learned(spark):
    rows = [(i, "the old house by the sea %d" % i, "en", "a", 1) for i in range(20)]
    rows += [(20 + i, "la maison de la mer est belle " * 3000, "fr", "a", 1) for i in range(3)]
    model = language_id.fit(frame(spark, rows))
    assert model.langs == ["en", "fr"]
    best, _ = model.predict([b"la maison est belle", b"the house by the sea"])
    assert [model.langs[b] for b in best] == ["fr", "en"]


@given
def test_language_held_out(spark):
    found = language_id.op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    right = found.where(F.col("held_out") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right[1] > 200 and right[0] > 0.95


def test_held_out_is_crc32_of_the_id_as_text(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").withColumn("h", held_out("doc_id", 3, 1)).collect()
    assert all(r.h == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 1) for r in rows)
