"""Benchmark decontamination with an FM-index of each training shard.

The benchmark's windows (13 consecutive words, or a whole shorter item) are the phrases. Each task turns its documents into
word numbers of the phrases' vocabulary, keeps the stretches in which every neighbouring pair of words also stands in some
phrase (only there a phrase can occur), and indexes these stretches as one shard: suffix order, Burrows-Wheeler transform and
a wavelet tree. All phrases are searched backwards at once through the tree's ranks; each occurrence is located from sampled
suffix positions, and its words are marked in its document. The benchmark is broadcast in parts of about PART_BYTES of text, one
pass over the texts for each: what a part hits is written before its broadcast goes and the next one comes, and the hits of all
parts meet their documents in a join by the text's digest. So nothing that is broadcast, or alive at a time, grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm import kernels as K
from skein.llm.common import bytes_of, packed, stash
from skein.sources.tables import table

WINDOW = 13
PART_BYTES = 4 << 20
#: Words in a shard's index at most (a longer document makes a longer shard of its own), and one suffix position in so many is kept.
SHARD_WORDS, SAMPLE = 1 << 20, 16
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased."""
    return bytes(text).translate(_WORD).split()


class WaveletTree:
    """Ranks of symbols in a sequence: one bit array of counts for each bit of the symbols, from the highest."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            count = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(bit) - int(count[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``upto``."""
        start, end = np.zeros_like(upto), upto
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            one_s, one_e = ones[start], ones[end]
            start, end = np.where(bit, zeros + one_s, start - one_s), np.where(bit, zeros + one_e, end - one_e)
        return end - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these places and their ranks there."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            one_a, one_s = ones[at], ones[start]
            at, start = np.where(bit, zeros + one_a, at - one_a), np.where(bit, zeros + one_s, start - one_s)
            symbol = symbol * 2 + bit
        return symbol, at - start


class FMIndex:
    """Backward search over a sequence of symbols of at least 1; 0 ends it."""

    def __init__(self, symbols: np.ndarray):
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        order, _ = K.suffix_order(text, len(text))
        before = text[order - 1]
        self.tree = WaveletTree(before, max(1, int(text.max()).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.sampled = np.full(len(text), -1, np.int64)
        keep = order % SAMPLE == 0
        self.sampled[keep] = order[keep]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range [lo, hi) of each phrase; phrases are right-aligned rows of symbols."""
        n = len(phrases)
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.sampled), np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            go = np.flatnonzero((lengths >= phrases.shape[1] - k) & (lo < hi))
            c = phrases[go, k]
            known = c < len(self.first) - 1
            hi[go[~known]] = lo[go[~known]]
            go, c = go[known], c[known]
            lo[go], hi[go] = self.first[c] + self.tree.rank(c, lo[go]), self.first[c] + self.tree.rank(c, hi[go])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back until a sampled one."""
        out, steps, at = np.empty(len(rows), np.int64), 0, rows.copy()
        open_ = np.arange(len(rows))
        while len(open_):
            got = self.sampled[at]
            done = got >= 0
            out[open_[done]] = got[done] + steps
            open_, at = open_[~done], at[~done]
            if len(open_):
                c, rank = self.tree.access(at)
                at = self.first[c] + rank
            steps += 1
        return out


class Phrases:
    """The distinct windows of some benchmark items as rows of word numbers, and which items hold each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], dict[str, None]] = {}
        for item, text in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 2) for w in words_of(text))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(ids[i : i + window], {})[item] = None
        self.items = [list(v) for v in found.values()]
        self.lengths = np.array([len(k) for k in found], np.int64)
        self.rows = np.zeros((len(found), window), np.int64)
        for r, k in enumerate(found):
            self.rows[r, window - len(k) :] = k
        base = len(self.numbers) + 2
        pairs = {a * base + b for k in found for a, b in zip(k, k[1:], strict=False)}
        self.base, self.pairs = base, np.array(sorted(pairs), np.int64)
        self.least = int(self.lengths.min()) if len(found) else window

    def stretches(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Number of words, and starts and ends of the stretches that could hold a phrase, with the word numbers."""
        words = words_of(text)
        get = self.numbers.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        if not len(ids) or not len(self.rows):
            return len(words), ids, ids[:0], ids[:0]
        pair = ids[:-1] * self.base + ids[1:]
        near = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        link = np.zeros(len(ids) + 1, bool)
        if len(self.pairs) and len(near):
            at = np.searchsorted(self.pairs, pair[near])
            at[at == len(self.pairs)] = 0
            link[near[self.pairs[at] == pair[near]] + 1] = True
        starts = np.flatnonzero((ids > 0) & ~link[:-1])
        ends = np.flatnonzero((ids > 0) & ~link[1:]) + 1
        long = ends - starts >= self.least
        return len(words), ids, starts[long], ends[long]


def find(texts: list[bytes], phrases: Phrases) -> list[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    """For each text: number of words, starts and ends (in words) of the merged hit spans, ids of the items that occur."""
    counts, parts, home, place = [], [], [], []
    for d, text in enumerate(texts):
        n, ids, starts, ends = phrases.stretches(text)
        counts.append(n)
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            parts += [ids[s:e], [1]]  # 1 keeps stretches apart
            home.append(d)
            place.append(s)
    spans: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    items: list[dict[str, None]] = [{} for _ in texts]
    if parts:
        sizes = np.array([len(p) for p in parts[::2]]) + 1
        offset = np.concatenate([[0], np.cumsum(sizes)])
        index = FMIndex(np.concatenate(parts))
        lo, hi = index.search(phrases.rows, phrases.lengths)
        hit = np.flatnonzero(hi > lo)
        # occurrences are located in blocks, so that very common phrases need no more memory
        for block in np.split(hit, np.flatnonzero(np.diff(np.cumsum(hi[hit] - lo[hit]) // SHARD_WORDS)) + 1):
            many = hi[block] - lo[block]
            rows = np.repeat(lo[block] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            which = np.repeat(block, many)
            at = index.locate(rows)
            part = np.searchsorted(offset, at, "right") - 1
            doc, start = np.array(home, np.int64)[part], np.array(place, np.int64)[part] + at - offset[part]
            order = np.argsort(doc, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []:
                d = int(doc[group[0]])
                spans[d].append((start[group], start[group] + phrases.lengths[which[group]]))
                for p in np.unique(which[group]).tolist():
                    items[d].update(dict.fromkeys(phrases.items[p]))
    out = []
    for n, s, i in zip(counts, spans, items, strict=True):
        a, b = K.merge_spans(*(np.concatenate(x) for x in zip(*s, strict=True))) if s else (np.empty(0, np.int64),) * 2
        out.append((n, a, b, list(i)))
    return out


HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])


def _searched(shared, text_col: str, drop_text: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in parts:
            row = batch.column(0)
            k = row.type.get_field_index(text_col)
            texts = [bytes(t) for t in bytes_of(row.field(k).cast(pa.string()))]
            found = [f for some in shards(texts) for f in find(some, phrases)]
            hits = pa.array([{"n_words": n, "spans": list(map(list, zip(a.tolist(), b.tolist(), strict=True))), "items": i} for n, a, b, i in found], type=HIT_ARROW)
            if drop_text:
                others = [i for i in range(row.type.num_fields) if i != k]
                row = pa.StructArray.from_arrays([row.field(i) for i in others], fields=[row.type.field(i) for i in others]) if others else pa.array([{}] * len(row), pa.struct([]))
            yield pa.RecordBatch.from_arrays([row, *batch.columns[1:], hits], names=[*batch.schema.names, "hits"])

    return run


def shards(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Whole documents, so many that one index holds them."""
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= 6 * SHARD_WORDS):
            size, to = size + len(texts[to]), to + 1
        yield texts[at:to]
        at = to


def _hits(shared):
    """digest, spans and items of the texts that are hit at all."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in parts:
            found = [f for some in shards([bytes(t) for t in bytes_of(batch.column(1))]) for f in find(some, phrases)]
            hit = [i for i, f in enumerate(found) if len(f[1])]
            spans = [list(map(list, zip(found[i][1].tolist(), found[i][2].tolist(), strict=True))) for i in hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit, pa.int64())), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([found[i][3] for i in hit], pa.list_(pa.string()))], names=["digest", "spans", "items"])

    return run


HIT_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def parts_of(benchmark: DataFrame, id_col: str, text_col: str, part_bytes: int) -> list:
    """Readers of the items, each of about part_bytes of text; an item is dealt to a part by its hash."""
    b = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    total = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // part_bytes))

    def read(k: int) -> Iterator[tuple[str, bytes]]:
        for r in b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toLocalIterator():
            yield (r["item"] or "", bytes(r["text"]))

    return [lambda k=k: read(k) for k in range(n)]


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES, keep_text: bool = True
) -> DataFrame:
    """Each row of docs as ``row`` (without its text if keep_text is False) with n_words, spans and items.

    spans: merged [start, end) in words; items: ids as strings, sorted, distinct, null as the empty string. A null or empty
    text has no words; an item without words has no window; an empty benchmark hits nothing; repeated items with one id are
    one item; a text of any length is searched whole.
    """
    context, df = docs.sparkSession.sparkContext, packed(docs, text_col, text_col).drop("doc_id")
    parts = parts_of(benchmark, item_col, item_text, part_bytes)
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    earlier = None
    for part in parts[:-1]:
        shared = context.broadcast(Phrases(list(part()), window))
        hits = stash(df.select(digest, F.col("text").cast("binary").alias("text")).where("text is not null").mapInArrow(_hits(shared), "digest binary, spans array<array<bigint>>, items array<string>"), "hits")
        shared.destroy()
        earlier = hits if earlier is None else earlier.unionByName(hits)
    shared = context.broadcast(Phrases(list(parts[-1]()), window))
    df = df.select("row", *[digest] * (earlier is not None))
    row = T.StructType([f for f in df.schema["row"].dataType if keep_text or f.name != text_col])
    df = df.mapInArrow(_searched(shared, text_col, not keep_text), T.StructType([T.StructField("row", row), *df.schema.fields[1:], T.StructField("hits", HITS)]))
    n_words, spans, items = F.col("hits")["n_words"], F.col("hits")["spans"], F.col("hits")["items"]
    if earlier is not None:
        # copies of a text have equal hits of a part, which count once before they are shuffled
        all_ = earlier.groupBy("digest").agg(F.flatten(F.collect_set("spans")).alias("more"), F.flatten(F.collect_set("items")).alias("others"))
        df = df.join(all_, "digest", "left")
        spans = F.when(F.col("more").isNull(), spans).otherwise(_merged(F.array_sort(F.concat("more", spans))))
        items = F.concat(F.coalesce("others", F.array().cast("array<string>")), items)
    return df.select("row", n_words.alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(items)).alias("items"))


def _merged(spans):
    """Sorted spans as disjoint maximal ones."""
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    longer = lambda acc, s: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.array(F.get(last(acc), 0), F.greatest(F.get(last(acc), 1), s[1]))))
    touch = lambda acc, s: (F.size(acc) > 0) & (F.get(last(acc), 1) >= s[0])
    return F.aggregate(spans, F.lit([]).cast("array<array<bigint>>"), lambda acc, s: F.when(touch(acc, s), longer(acc, s)).otherwise(F.concat(acc, F.array(s))))


def contamination(found: DataFrame) -> DataFrame:
    """found with n_hit and contaminated: at least one word in twenty is inside an occurrence."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these spans (numbered as words_of does) and what stands between them."""
    data = text.encode()
    keep = np.frombuffer(data.translate(_WORD), np.uint8)
    starts, ends = K.word_spans(keep, K.separators(b" "))
    out, at = [], 0
    for s, e in spans:
        out.append(data[at : starts[s]])
        at = int(ends[e - 1])
    return b"".join([*out, data[at:]]).decode()


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(find_benchmark(docs, table(spark, sf_dir, "benchmark"), keep_text=False))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM iw) ks, unnest(range(1, len(w) - k + 2)) AS t(i)
), h AS (
  SELECT doc_id, item_id, i, k FROM dw JOIN iw USING (k, g)
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""
