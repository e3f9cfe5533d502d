"""Conversation repair against an exhaustive search over edits, and against a DP of whole conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from skein.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, marks, inserts=3):
    """(cost, audit, repaired) by trying every string of edits with a few inserts."""
    best = None
    n = len(rows)
    for kinds in itertools.product("KRD", repeat=n):
        if any(k != "D" and m in ("blank", "duplicate") for k, m in zip(kinds, marks, strict=True)):
            continue
        for holes in itertools.product(range(inserts + 1), repeat=n + 1):
            if sum(holes) > inserts:
                continue
            audit = "I" * holes[0] + "".join(k + "I" * h for k, h in zip(kinds, holes[1:], strict=True))
            cost = sum({"K": 0, "R": 1, "D": 2}[k] + 5 * (m == "truncated" and k != "D") for k, m in zip(kinds, marks, strict=True)) + 5 * sum(holes)
            if best and (cost, audit) >= best[:2]:
                continue
            slots = [[rows[i][0]] if k == "K" else ["user", "assistant"] for k, i in walk(audit) if k != "D"]
            for roles in itertools.product(*slots):
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r in roles)) and all(roles):
                    texts = ["" if k == "I" else rows[i][1] for k, i in walk(audit) if k != "D"]
                    best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in zip(roles, texts, strict=True)))
    return best


def walk(audit):
    i = 0
    for k in audit:
        yield k, i
        i += k != "I"


def brute(conversations):
    """Each conversation's result from its rows (turn, role, text)."""
    out = {}
    for conv, rows in conversations.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        plain = [(r, t) for _, r, t in rows]
        marks = faults(plain)
        turns = {t for t, *_ in rows if t is not None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(plain))
        cost, audit, text = cheapest(plain, marks)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def results(found, lines):
    shas = {r.conv_id: r.repaired_sha256 for r in C.digests(lines).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, shas.get(r.conv_id, hashlib.sha256().hexdigest())) for r in found.collect()}


def some(r, n, long=5):
    texts = ["Yes.", "No!", "why?", "cut off", "", "  \n", "and. ", "é."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", ""]
    return {c: [(r.choice([None, 0, 1, 2, 3, 3, 9]), r.choice(roles), r.choice(texts)) for _ in range(r.randint(1, long))] for c in range(n)}


@pytest.mark.parametrize("segment", [2, 256])
def test_against_all_edits(spark, monkeypatch, segment):
    monkeypatch.setattr(C, "SEGMENT", segment)
    conversations = some(random.Random(segment), 60, 4)
    conversations[None] = [(None, "user", "Hi."), (4, "assistant", "Ho.")]
    rows = [(c, t, role, text) for c, rs in conversations.items() for t, role, text in rs]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumn("segment", F.lit("x")).withColumn("a.b", F.lit(1))
    assert results(*C.repair(turns)) == brute(conversations)


def reference(tokens):
    """(cost, audit) of a string of tokens, by the whole string alone."""
    layer = C.inserted([(0, ""), None, None, None])
    for t in tokens:
        layer = C.stepped(layer, t)
    return min(x for x in (layer[C.NONE], layer[C.A]) if x)


def test_segments_compose():
    r = random.Random(2)
    strings = ["".join(r.choice("suaxUAo") for _ in range(r.randint(0, 30))) for _ in range(300)]
    cut = {(s[i : i + 7] if i else "^" + s[:7]) for s in strings for i in range(0, max(1, len(s)), 7)}
    trie, solved = C.Trie(), {}
    for s in sorted(cut):
        solved[s] = trie.solve(s)
    for s in strings:
        layer = solved["^" + s[:7]][0]
        for i in range(7, len(s), 7):
            layer = C.composed(layer, solved[s[i : i + 7]])
        assert min(x for x in (layer[C.NONE], layer[C.A]) if x) == reference(s)


def test_shared_prefixes_are_computed_once(monkeypatch):
    steps = []
    monkeypatch.setattr(C, "stepped", lambda layer, token, f=C.stepped: steps.append(token) or f(layer, token))
    trie = C.Trie()
    for s in sorted(["^sua", "^suau", "^suaua", "^ua"]):
        trie.solve(s)
    assert "".join(steps) == "suauaua"


def test_a_conversation_that_holds_most_rows(spark):
    """One conversation is spread over tasks and segments, and one row stands in it very often."""
    r = random.Random(7)
    rows = [(1, i, ["user", "assistant"][i % 2] if r.random() < 0.9 else "system", f"text {i}{r.choice(['.', ''])}") for i in range(3000)]
    rows += [(1, 7, "user", "same.")] * 1500 + [(c, i, ["user", "assistant"][i], "Hello.") for c in range(2, 40) for i in range(2)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(8)
    found, lines = C.repair(turns)
    got = results(found, lines)
    ordered = sorted(rows[:4500], key=lambda x: (x[1], x[2], hashlib.sha256(x[3].encode()).digest()))
    marks = faults([(a, b) for *_, a, b in ordered])
    tokens = ["x" if m in ("blank", "duplicate") else (x[2][0].upper() if m else x[2][0]) for x, m in zip(ordered, marks, strict=True)]
    assert (got[1][5], got[1][6]) == reference(tokens) and got[1][0] == 0 and got[1][2] == marks.count("duplicate") == 1499
    assert got[1][4] == sum(a[2][0] + b[2][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(ordered))
    assert all(got[c][5:7] == (0, "KK") for c in range(2, 40))


def test_empty_and_null(spark):
    found, lines = C.repair(spark.createDataFrame([], SCHEMA))
    assert found.collect() == [] and lines.collect() == []
    found, lines = C.repair(spark.createDataFrame([(1, None, None, None), (None, None, "user", None), (2, 1, "user", "x" * 2_000_000 + "."), (2, 2, "assistant", "ok.")], SCHEMA))
    assert {r.conv_id: (r.gaps, r.blank, r.cost, r.audit) for r in found.collect()} == {1: (0, 1, 2, "D"), None: (0, 1, 2, "D"), 2: (0, 0, 0, "KK")}
    assert [(r.role, len(r.text)) for r in lines.collect()] == [("user", 2_000_001), ("assistant", 3)]


def test_damage(spark):
    rows = [(c, t, "system", "One. Two!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = sorted((r.conv_id if r.conv_id is not None else -1, r.turn if r.turn is not None else -1, r.role, r.text) for r in C.damaged(spark.createDataFrame(rows, SCHEMA)).collect())
    want = []
    for c, t, role, text in rows:
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        want += [(-1 if c is None else c, -1 if t is None else t, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    assert got == sorted(want)


def test_query_with_awkward_rows(spark, tmp_path):
    import duckdb

    import oracle

    r = random.Random(11)
    rows = [(c, t, role, text) for c, rs in some(r, 80, 9).items() for t, role, text in rs]
    rows += [(None, None, None, None), (500, None, "user", None), *[(501, 0, "user", "Hi.")] * 3]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert oracle.differences(C.op12_repair(spark, str(tmp_path)), con, C.OP12_SQL) == []
