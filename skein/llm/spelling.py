"""Spelling variants: words one edit apart, found by a rare-first q-gram prefix filter.

All bigrams are ordered by how often they stand in words. One edit spoils at most two of a word's bigrams, so of its three rarest
(by frequency, bigram and place) the rarest that the edit spares is among the three rarest of the other word too, at the same place
or, behind an insert, one further. So a word goes to a bucket (bigram, place, length) for each of its three, and, as the longer of
two, to the buckets of words one shorter at both places: nine rows for a word, whatever its neighbours are.

Inside a bucket no pairs are formed: words that agree when one place is hidden, or when one letter of the longer is left out, meet by
a sorted hash of what is left and are then compared letter by letter. A bucket of over HOT rows is dealt anew by those hashes before
the shuffle, so that its groups are no larger than the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import batches, column_np, stash
from skein.llm.conversations import CRC_TABLE, crc_sql
from skein.sources.tables import table

LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, TIMES, DAMAGED = 7, 2, 10, 31
RAREST = 3
#: Rows of a bucket beyond which it is dealt by hashes; letters that a task looks at together.
HOT, LETTERS_AT_ONCE = 200_000, 1 << 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits of each number, well spread."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + _MIX[0]
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
    return z ^ (z >> np.uint64(31))


class Ragged:
    """Words as one array of letters; word, place: which word a letter is of and where in it."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray):
        self.letters, self.lengths = letters, lengths
        self.start = np.cumsum(lengths) - lengths
        self.word = np.repeat(np.arange(len(lengths)), lengths)
        self.place = np.arange(len(letters)) - self.start[self.word]

    @staticmethod
    def of(column: pa.Array) -> Ragged:
        """A column of binary values."""
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        letters = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.empty(0, np.uint8)
        return Ragged(letters, np.diff(at))

    def hashes(self, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word, of each word without the letter at a place (which stays hidden there), and of each word with a letter left out."""
        with np.errstate(over="ignore"):
            value = self.letters.astype(np.uint64) + np.uint64(1)
            here, before = value * mixed(self.place), value * mixed(self.place - 1)
            sums, shifted = (np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (here, before))
            end = self.start + self.lengths
            own = salt + mixed(self.lengths) + sums[end] - sums[self.start]
            at = np.arange(len(value))
            hidden = own[self.word] - here + mixed(self.place + (1 << 40))
            left_out = (salt + mixed(self.lengths - 1))[self.word] + sums[at] - sums[self.start[self.word]] + shifted[end[self.word]] - shifted[at + 1]
        return own, hidden, left_out

    def run_starts(self) -> np.ndarray:
        """Letters that differ from the one before them in their word: leaving out another of a run gives the same word."""
        fresh = self.place == 0
        fresh[1:] |= self.letters[1:] != self.letters[:-1]
        return np.flatnonzero(fresh)


def rarest(words: Ragged, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word, bigram and place of the three rarest bigrams of each word; often: by bigram (two letters as 16 bits)."""
    first = np.flatnonzero(words.place < (words.lengths - 1)[words.word])
    gram = words.letters[first].astype(np.int64) << 8 | words.letters[first + 1]
    order = np.lexsort((words.place[first], gram, often[gram], words.word[first]))
    word = words.word[first][order]
    begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, np.int64)
    rank = np.arange(len(word)) - np.repeat(begin, np.diff(np.r_[begin, len(word)]))
    best = order[rank < RAREST]
    return words.word[first][best], gram[best], words.place[first][best]


def buckets(words: Ragged, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word, bucket and whether the word is the longer one there, for the rows of each word."""
    word, gram, place = rarest(words, often)
    size = words.lengths[word]

    def bucket(p, n):
        return ((gram.astype(np.uint64) << np.uint64(48)) ^ (p.astype(np.uint64) << np.uint64(24)) ^ n.astype(np.uint64)).view(np.int64)

    inner = place > 0
    rows = np.concatenate([word, word, word[inner]])
    keys = np.concatenate([bucket(place, size), bucket(place, size - 1), bucket(place - 1, size - 1)[inner]])
    longer = np.arange(len(rows)) >= len(word)
    _, one = np.unique(np.stack([rows, keys, longer]), axis=1, return_index=True)  # a run of one letter meets a bucket twice
    return rows[one], keys[one], longer[one]


def _grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each bigram stands in words."""
    often = np.zeros(1 << 16, np.int64)
    for batch in parts:
        words = Ragged.of(batch.column(0))
        first = np.flatnonzero(words.place < (words.lengths - 1)[words.word])
        often += np.bincount(words.letters[first].astype(np.int64) << 8 | words.letters[first + 1], minlength=1 << 16)
    found = np.flatnonzero(often)
    yield from batches(pa.schema([("gram", pa.int64()), ("n", pa.int64())]), [found, often[found]])


def _sizes(often):
    """How many rows a task has for each bucket."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            _, keys, _ = buckets(Ragged.of(batch.column(0)), often.value)
            found, n = np.unique(keys, return_counts=True)
            yield from batches(pa.schema([("bucket", pa.int64()), ("n", pa.int64())]), [found, n])

    return run


_ROW = pa.schema([("key", pa.int64()), ("longer", pa.bool_()), ("word", pa.binary()), ("n", pa.int64())])


def _dealt(often, hot):
    """A row for each word and bucket; in a hot bucket one for each hidden place, and for the word or each letter left out."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = np.sort(hot.value)
        for whole in parts:
            for lo in range(0, len(whole), 5000):
                batch = whole.slice(lo, 5000)
                words = Ragged.of(batch.column(0))
                word, key, longer = buckets(words, often.value)
                at = np.searchsorted(heavy, key)
                is_hot = np.isin(key, heavy) if len(heavy) else np.zeros(len(at), bool)
                out = [(word[~is_hot], key[~is_hot], longer[~is_hot])]
                if is_hot.any():
                    rows = np.flatnonzero(is_hot)
                    lengths = words.lengths[word[rows]]
                    copies = Ragged(words.letters[np.repeat(words.start[word[rows]] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())], lengths)
                    own, hidden, left_out = copies.hashes(mixed(key[rows].view(np.uint64)))
                    w, long_ = word[rows], longer[rows]
                    short, letters = np.flatnonzero(~long_), copies.run_starts()
                    letters = letters[long_[copies.word[letters]]]
                    places = np.flatnonzero(~long_[copies.word])
                    out += [(w[short], mixed(own[short]).view(np.int64), np.zeros(len(short), bool)), (w[copies.word[letters]], mixed(left_out[letters]).view(np.int64), np.ones(len(letters), bool)), (w[copies.word[places]], mixed(hidden[places]).view(np.int64), np.zeros(len(places), bool))]
                word, key, longer = (np.concatenate(x) for x in zip(*out, strict=True))
                for s in range(0, len(word), 50_000):
                    take = pa.array(word[s : s + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(key[s : s + 50_000]), pa.array(longer[s : s + 50_000]), batch.column(0).take(take), batch.column(1).take(take)], schema=_ROW)

    return run


def equal_pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of equal keys."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(k[1:] == k[:-1])
    a, b, step = [], [], 1
    while len(at):
        a.append(order[at])
        b.append(order[at + step])
        step += 1
        at = at[at + step < len(k)]
        at = at[k[at + step] == k[at]]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def near_pairs(words: Ragged, key: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words one edit apart among those of one key, of which one is not the longer."""
    own, hidden, left_out = words.hashes(mixed(key.view(np.uint64)))
    places = np.flatnonzero(~longer[words.word])
    i, j = equal_pairs(hidden[places])
    a, b = words.word[places[i]], words.word[places[j]]
    same = words.lengths[a] == words.lengths[b]
    a, b = a[same], b[same]
    n = words.lengths[a]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    differ = words.letters[np.repeat(words.start[a], n) + at] != words.letters[np.repeat(words.start[b], n) + at]
    one = np.bincount(np.repeat(np.arange(len(n)), n), differ, len(n)) == 1
    found = [(a[one], b[one])]
    short = np.flatnonzero(~longer)
    letters = words.run_starts()
    letters = letters[longer[words.word[letters]]]
    if len(short) and len(letters):
        order = np.argsort(own[short], kind="stable")
        sorted_ = own[short][order]
        lo, hi = (np.searchsorted(sorted_, left_out[letters], side) for side in ("left", "right"))
        times = hi - lo
        which = np.repeat(np.arange(len(letters)), times)
        a = short[order[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]]
        out = letters[which]
        b = words.word[out]
        fits = words.lengths[a] + 1 == words.lengths[b]
        a, b, out = a[fits], b[fits], out[fits]
        n = words.lengths[a]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of_long = np.repeat(words.start[b], n) + at + (at >= np.repeat(words.place[out], n))
        differ = words.letters[np.repeat(words.start[a], n) + at] != words.letters[of_long]
        equal = np.bincount(np.repeat(np.arange(len(n)), n), differ, len(n)) == 0
        found.append((a[equal], b[equal]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


_PAIR = pa.schema([("word", pa.binary()), ("other", pa.binary()), ("n", pa.int64())])


def _near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word with each of its near words, from rows in the order of their keys; looks at whole keys of about LETTERS_AT_ONCE letters."""
    held: list[pa.RecordBatch] = []
    size = 0

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = table.combine_chunks().to_batches()[0] if len(table) else None
        if batch is None:
            return
        a, b = near_pairs(Ragged.of(batch.column(2)), column_np(batch, "key"), batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
        for x, y in ((a, b), (b, a)):
            for s in range(0, len(x), 50_000):
                one, two = pa.array(x[s : s + 50_000]), pa.array(y[s : s + 50_000])
                yield pa.RecordBatch.from_arrays([batch.column(2).take(one), batch.column(2).take(two), batch.column(3).take(two)], schema=_PAIR)

    for batch in parts:
        held.append(batch)
        size += batch.column(2).nbytes
        if size < LETTERS_AT_ONCE:
            continue
        table = pa.Table.from_batches(held)
        key = column_np(batch, "key")
        cut = len(table) - int((key == key[-1]).sum())
        if cut > len(table) - len(batch):  # the last key may go on
            yield from found(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size = sum(b.column(2).nbytes for b in held)
    if held:
        yield from found(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """word, other and n (of other) for each ordered pair of ``words`` (word, n; distinct) at one inserted, deleted or replaced code point."""
    coded = stash(words.select(F.encode("word", "ISO-8859-1").alias("word"), "n"), "words")
    context = words.sparkSession.sparkContext
    counts = coded.mapInArrow(_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # two letters of 256: at most 65,536 rows
    often = np.zeros(1 << 16, np.int64)
    for gram, n in counts:
        often[gram] = n
    often = context.broadcast(often)
    sizes = coded.mapInArrow(_sizes(often), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    hot = context.broadcast(np.array([r.bucket for r in sizes.where(F.col("n") > HOT).select("bucket").collect()], np.int64))  # at most nine rows a word over HOT
    dealt = coded.mapInArrow(_dealt(often, hot), "key long, longer boolean, word binary, n long").repartition("key").sortWithinPartitions("key")
    pairs = dealt.mapInArrow(_near, "word binary, other binary, n long").distinct()
    return pairs.select(F.decode("word", "ISO-8859-1").alias("word"), F.decode("other", "ISO-8859-1").alias("other"), "n")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n for ``words`` (word, n), which are distinct and of letters up to U+00FF.

    Words of fewer than LEAST_LENGTH letters have too few bigrams for the filter and raise an error, as do other letters. A form is the
    near word of the largest n, ties by code point, if that is at least ``times`` (over 1) the word's; the root is where forms lead.
    An empty table gives an empty result.
    """
    if times <= 1:
        raise ValueError("forms must be more frequent than their variants, or roots have no end")
    checked = F.when(F.length("word") >= LEAST_LENGTH, F.col("word")).otherwise(F.raise_error(F.lit(f"words must have {LEAST_LENGTH} letters or more")))
    words = stash(words.select(checked.alias("word"), F.col("n").cast("long").alias("n")), "vocabulary")
    near = near_words(words).groupBy(F.col("word").alias("w")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("other"))).alias("best"))
    found = words.join(near, F.col("word") == F.col("w"), "left").drop("w")
    is_form = F.expr(f"-best.less div {int(times)} >= n")  # times n may be over a long
    found = stash(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    # forms grow by ``times`` at each step, so a chain has at most log(most) steps, and each round doubles what a root spans
    most = found.agg(F.max("form_n")).first()[0] or 0
    steps, least = 0, LEAST_COUNT
    while least * times <= most:
        steps, least = steps + 1, least * times
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    span = 1
    while span < steps:
        roots = stash(roots, "roots")
        onward = roots.select(F.col("word").alias("at"), F.col("root").alias("next"))
        roots = roots.join(onward, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"))
        span *= 2
    out = found.join(roots.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int = DAMAGED) -> DataFrame:
    """word and n of the words of LEAST_LENGTH letters or more that stand LEAST_COUNT times in all texts (null: none).

    Only A-Z are lower-cased. Where ``damaged`` divides the crc32 of ``id:word`` (a null id is empty), the code point at that number modulo the length is deleted.
    """
    runs = F.regexp_extract_all(docs[f"`{text_col}`"], F.lit(f"({LETTERS}{{{LEAST_LENGTH},}})"), F.lit(1))
    rows = docs.select(F.coalesce(docs[f"`{id_col}`"].cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % damaged == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted(table(spark, sf_dir, "documents")))


OP13_SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}), r AS (
  SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL
), h AS (
  SELECT run, k, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM r, crc
), v AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), m AS (
  SELECT word, n, substr(word, 1, j - 1) AS a, substr(word, j + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS j FROM v)
), s AS (
  SELECT DISTINCT x.word AS short, x.n AS short_n, m.word AS long, m.n AS long_n FROM m JOIN v x ON m.a || m.b = x.word
), near AS (
  SELECT x.word, y.word AS other, y.n FROM m x JOIN m y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT short, long, long_n FROM s UNION ALL SELECT long, short, short_n FROM s
), g AS (
  SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN g.most >= 10 * v.n THEN g.most END AS form_n,
         CASE WHEN g.most >= 10 * v.n THEN (SELECT min(other) FROM near WHERE near.word = v.word AND near.n = g.most) END AS form
  FROM v LEFT JOIN g ON g.word = v.word
), w AS (
  SELECT word, word AS root FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM f JOIN w ON w.word = f.word JOIN f z ON z.word = w.root AND z.form IS NULL
"""
