import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa
from cases import corpus, frame
from skein.llm import exact_dedup as exact
from skein.llm.exact_dedup import digests, exact_dedup, merge_runs


def brute(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        out += [(m[2], best, len(members), hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = corpus()
    got = exact_dedup(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_empty_and_clashing_columns(spark):
    assert exact_dedup(frame(spark, [])).count() == 0
    df = spark.createDataFrame([(1, "a", 5), (2, "a ", 6)], "doc_id long, text string, keep_id long")
    assert {(r.doc_id, r.keep_id, r.row.keep_id, r.kept) for r in exact_dedup(df).collect()} == {(1, 2, 5, False), (2, 2, 6, True)}


def test_rounds_do_not_matter(spark):
    rows = digests(frame(spark).select("doc_id", "text").repartition(11))
    one, many = ({(bytes(r.digest), tuple(r.best), r.group_size) for r in merge_runs(rows, f).collect()} for f in (64, 2))
    assert one == many


def test_merge_in_chunks(spark, monkeypatch):
    """Chunks and merges of a few rows, with a text that holds a third of all rows and copies on every border."""
    for name, value in (("CHUNK", 3), ("TOGETHER", 5)):
        monkeypatch.setattr(exact, name, value)
    r = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else " " * r.randrange(4) + f"t{r.randrange(90)}") for i in range(600)]
    r.shuffle(rows)
    parts = []
    for k in range(4):  # runs of a hundred and fifty
        own = [(hashlib.sha256(re.sub(" ", "", t).encode()).digest(), len(t.strip()), 7, -len(t), False, d, 1) for d, t in rows[k * 150 : k * 150 + 150]]
        columns = list(zip(*sorted(own), strict=True))
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        whole = pa.Table.from_arrays([pa.array([k] * 150, pa.int64()), *map(pa.array, columns, types)], schema=pa.schema([pa.field(n, t, n in ("digest", "doc_id")) for n, t in zip(["run", *exact.KEYS, "count"], [pa.int64(), *types], strict=True)]))
        parts += exact._runs(1)(iter(whole.to_batches(max_chunksize=7)))
    order = sorted((x for b in parts for x in b.to_pylist()), key=lambda x: (x["range"], x["first"]))
    assert all(pa.ipc.open_stream(x["rows"]).read_all().num_rows <= 3 for x in order)
    met = [pa.RecordBatch.from_pylist([x | {"run": 0} for x in order[i : i + 4]], schema=parts[0].schema) for i in range(0, len(order), 4)]
    got = [x for b in exact._merge(None)(iter(met)) for x in b.to_pylist()]
    want = {digest: (best, size) for _, best, size, digest in brute(rows)}
    assert {x["digest"].hex(): (x["doc_id"], x["count"]) for x in got} == want and len(got) == len(want)


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "xy "), (None, "xy "), ("c", None)], "doc_id string, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(df).collect()}
    assert got == {("b", "a", 3, False), ("a", "a", 3, True), (None, "a", 3, False), ("c", "c", 1, True)}
