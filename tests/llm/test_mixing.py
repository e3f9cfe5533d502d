import random
import re
from collections import defaultdict

import pytest
from cases import corpus, frame
from pyspark.sql import functions as F
from skein.llm.mixing import mix


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    target, fixed, total = {}, set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(target[s] for s in fixed)
        target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = 2.0 * sizes[s]
            fixed.add(s)


def test_targets_and_words(spark):
    rows = corpus(2, 200)
    got = mix(frame(spark, rows)).collect()
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    for r in got:
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[r.source]
    target = expected_targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in got} == target
    for s in sizes:
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6
    assert sorted(str((r.doc_id, r.taken)) for r in mix(frame(spark, rows)).collect()) == sorted(str((r.doc_id, r.taken)) for r in got)


def test_unequal_weights_and_empty(spark):
    rows = [(i, "w " * 10, "en", "a" if i % 2 else "b", 20) for i in range(400)]
    df = frame(spark, rows).selectExpr("*", "cast(doc_id % 4 as double) tilt")
    got = mix(df, weight_col="tilt", weights=(1.0, 1.0), share=0.4, most=1.0).collect()
    n = defaultdict(int)
    for r in got:
        n[r.row.tilt] += r.copies
    assert n[0.0] == 0 and n[3.0] > 1.8 * n[1.0] and sum(r.taken for r in got) == pytest.approx(0.4 * 4000, abs=20)
    assert mix(frame(spark, [])).count() == 0


@pytest.mark.parametrize("share", [0.3, 1.0, 1.5, 1.9, 2.0])
def test_weights_within_the_limit_reach_the_target(spark, share):
    """Weights from 1 to 4 in every source: the heavy ones stop at two copies and the others make up for them."""
    r = random.Random(5)
    rows = [(i, "w " * r.randint(1, 400), "en", r.choice(["a", "a", "a", "b", None]), 20) for i in range(900)]
    df = frame(spark, rows).withColumn("heavy", F.length(F.col("n_chars").cast("string")) + F.col("doc_id") % 3)
    got = mix(df, weight_col="heavy", share=share).collect()
    taken, target, copies = defaultdict(int), {}, defaultdict(list)
    for x in got:
        assert x.copies in (0, 1, 2)
        taken[x.source] += x.taken
        target[x.source] = x.target
        copies[x.source, x.row.heavy].append(x.copies)
    assert all(abs(taken[s] - target[s]) <= 200 for s in target)
    mean = {k: sum(c) / len(c) for k, c in copies.items()}
    assert all(mean[s, 4] >= mean[s, 2] - 0.15 for s in ("a", "b")) and (share != 0.3 or mean["a", 4] > mean["a", 2])


def test_a_column_of_any_name_and_repeated_ids(spark):
    rows = [(1, "a b c d", "en", "s", 1)] * 50 + [(i, "e f g h", "en", "s", 1) for i in range(2, 52)]
    df = frame(spark, rows).withColumns({c: F.lit("x") for c in ("size", "target", "copies", "row", "q", "g")})
    got = mix(df, share=0.5).collect()
    assert sum(r.taken for r in got) == pytest.approx(200, abs=4) and all(r.row.size == "x" for r in got)


@pytest.mark.parametrize("scale", [0.004, 1.0, 1e6, 1e-12])
def test_only_how_weights_compare_counts(spark, scale):
    """Weights of any size meet the target, and a document of ten times the weight is taken more often."""
    rows = [(i, "w " * 10, "en", "a", 20) for i in range(600)]
    df = frame(spark, rows).withColumn("heavy", F.when(F.col("doc_id") % 3 == 0, 10.0).otherwise(1.0) * F.lit(scale))
    got = mix(df, weight_col="heavy", share=0.25).collect()
    assert sum(r.taken for r in got) == pytest.approx(0.25 * 6000, abs=10)
    heavy, light = (sum(r.copies for r in got if (r.row.doc_id % 3 == 0) == h) for h in (True, False))
    assert 4 * light < heavy


@pytest.mark.parametrize("bad", ["NaN", "Infinity", "-1"])
def test_weights_that_are_none_raise(spark, bad):
    df = frame(spark, [(1, "a b", "en", "a", 3), (2, "a b", "en", "a", 3)]).withColumn("heavy", F.when(F.col("doc_id") == 1, F.lit(bad).cast("double")).otherwise(1.0))
    with pytest.raises(Exception, match="finite"):
        mix(df, weight_col="heavy").collect()
    assert len(mix(df.withColumn("heavy", F.lit(None).cast("double")), weight_col="heavy").collect()) == 2
