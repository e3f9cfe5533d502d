"""Language-model scoring: corpus word counts and a causal self-attention model over subword ids.

Words of all training documents are counted on Spark, and these counts name the attention model's units. The model
(attention.py) learns from every training document whole: documents are dealt to ROUNDS rounds and to learners by hash, in a round
each learner goes through its own texts from the same parameters, and the next round begins at the mean of what the learners came
to, weighted by their units and formed in a tree. It scores every text whole in overlapping windows, each subword once. A word's
probability mixes its share of the training tokens with the model's probability of its subwords, which includes that the word
ends there, so both are distributions over words.

Documents are dealt to blocks of about BLOCK bytes by hash. A block's distinct words meet the counts in one join and go back to
the block, so what is shuffled for a document is not its tokens but its block's vocabulary, and no task holds more than that.
"""

from __future__ import annotations

import base64
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.attention import WINDOW, Model, Units
from skein.llm.common import batches, bytes_of, column_np, discard, ids_and_bytes, stash, with_null_ids, written
from skein.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BLOCK, ROUNDS, STEPS, SHARE = 16 << 20, 8, 1400, 0.4
#: Parameters of a model that are averaged together; windows of a step of training; tasks whose parameters are averaged at once.
PIECE, BATCH, FAN = 1 << 14, 64, 128
#: Characters of a word that are tokenized at a time.
PART = 48
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Stands for the end of a text among the words.
END = b""


def words_of(text) -> list[bytes]:
    """Words of [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased."""
    return bytes(text).translate(_LOWER).split()


class Subwords:
    """A public tokenizer's byte pairs; ranks: its vocabulary."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.begins = np.zeros(self.size, bool)
        self.begins[[n for t, n in self.ranks.items() if t.startswith(b" ")]] = True
        self._encoding = None

    def __getstate__(self):
        return self.__dict__ | {"_encoding": None}

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, each after a blank, and how many each word has; a long word is cut into parts first.

        As words hold no blank, each begins with the one id of its own that starts with a blank.
        """
        if self._encoding is None:
            self._encoding = tiktoken.Encoding("words", pat_str=r" ?[^ ]+", mergeable_ranks=self.ranks, special_tokens={})
        encode, out = self._encoding.encode_ordinary, []
        texts = [w.decode("utf-8", "replace") for w in words]
        long = [i for i, t in enumerate(texts) if len(t) > PART]
        at = 0
        for i in [*long, len(texts)]:
            for lo in range(at, i, 10_000):
                out += encode(" " + " ".join(texts[lo : min(i, lo + 10_000)]))
            if i < len(texts):
                for lo in range(0, len(texts[i]), PART):
                    out += encode(" " * (lo == 0) + texts[i][lo : lo + PART])
            at = i + 1
        flat = np.array(out, np.int64)
        return flat, np.diff(np.append(np.flatnonzero(self.begins[flat]), len(flat)))


def sequence(text, units: Units, subwords: Subwords) -> np.ndarray:
    """The units of a text and its end."""
    flat, _ = subwords.ids(words_of(text))
    return np.append(units.of(flat, subwords.begins[flat]), units.end)


def new_model(begin: np.ndarray, inner: np.ndarray, ends: int, subwords: Subwords) -> Model:
    """An untrained model for ids that begin words, and stand inside words, this often, with so many ends of texts."""
    units = Units(begin, inner, subwords.size)
    model = Model(units)
    count = np.bincount(units.of_begin, begin, units.n) + np.bincount(units.of_inner, inner, units.n)
    count[units.end] += ends
    if ends:
        model.begin_at(count)
    return model


def train(texts: list[bytes], subwords: Subwords, steps: int = STEPS) -> Model:
    """A model of these texts, trained here; with none it is untrained but still a distribution."""
    flat, _ = subwords.ids([w for t in texts for w in words_of(t)])
    first = subwords.begins[flat]
    model = new_model(np.bincount(flat[first], minlength=subwords.size), np.bincount(flat[~first], minlength=subwords.size), len(texts), subwords)
    model.fit([sequence(t, model.units, subwords) for t in texts], steps if texts else 0)
    return model


def _ids(shared):
    """How often ids begin words (id) and stand inside words (-1 - id), from words with counts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = shared.value
        begin, inner = np.zeros(subwords.size, np.int64), np.zeros(subwords.size, np.int64)
        for batch in parts:
            words, c = batch.column(0).to_pylist(), column_np(batch, "c")
            real = np.array([w != END for w in words], bool)
            flat, size = subwords.ids([w for w in words if w != END])
            times = np.repeat(c[real], size)
            first = subwords.begins[flat]
            np.add.at(begin, flat[first], times[first])
            np.add.at(inner, flat[~first], times[~first])
        a, b = np.flatnonzero(begin), np.flatnonzero(inner)
        yield from batches(pa.schema([("id", pa.int64()), ("n", pa.int64())]), [np.concatenate([a, -1 - b]), np.concatenate([begin[a], inner[b]])])

    return run


def _learned(shared, model, passes: int, expected: float, rates: tuple[float, float], seed: int, tasks: int):
    """Mean parameters that the learners of a task come to from the model's, weighted by their units, in pieces."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, start = shared.value, model.value

        def rows() -> Iterator[tuple[int, memoryview]]:
            for batch in parts:
                yield from zip(column_np(batch, "learner").tolist(), bytes_of(batch.column(1)), strict=True)

        task, units, total = 0, 0, 0.0
        for learner, texts in groupby(rows(), key=lambda row: row[0]):
            own = Model(start.units)
            for n, x in start.p.items():
                own.p[n] = x.copy()
            _, seen = own.fit(sequences((t for _, t in texts), Vocabulary(own, subwords)), 0, expected, rates, batch=BATCH, seed=seed, passes=passes)
            task, units = learner % tasks, units + seen
            total = total + np.concatenate([own.p[n].ravel() for n in Model.NAMES]).astype(np.float64) * seen
        if units:
            yield _pieces(range(-(-len(total) // PIECE)), task, units, [total[at : at + PIECE] for at in range(0, len(total), PIECE)])

    return run


def _pieces(numbers: Iterable[int], task: int, units: int, sums: list[np.ndarray]) -> pa.RecordBatch:
    numbers = list(numbers)
    values = pa.array([(x / units).astype(np.float32).tobytes() for x in sums], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([task] * len(numbers), pa.int64()), pa.array([units] * len(numbers), pa.int64()), values], names=["piece", "task", "units", "values"])


def _averaged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of the pieces of each group of tasks, weighted by units; they come in order, and one is held at a time."""
    at, units, total = None, 0, np.empty(0)
    for batch in parts:
        for p, t, u, x in zip(column_np(batch, "piece").tolist(), column_np(batch, "task").tolist(), column_np(batch, "units").tolist(), bytes_of(batch.column(3)), strict=True):
            if (p, t // FAN) != at:
                if at is not None:
                    yield _pieces([at[0]], at[1], units, [total])
                at, units, total = (p, t // FAN), 0, np.zeros(len(x) // 4)
            units += u
            total += np.frombuffer(x, np.float32).astype(np.float64) * u
    if at is not None:
        yield _pieces([at[0]], at[1], units, [total])


PIECES = "piece long, task long, units long, values binary"


def averaged(found: DataFrame, tasks: int) -> DataFrame:
    """One row for each piece: pieces of FAN tasks meet, then those of FAN such groups, so no key has more than FAN rows."""
    while True:
        group = F.expr(f"task div {FAN}")
        found = found.repartition("piece", group).sortWithinPartitions("piece", "task").mapInArrow(_averaged, PIECES)
        tasks = -(-tasks // FAN)
        if tasks == 1:
            return found


def trained(rows: DataFrame, counts: DataFrame, subwords, steps: int, rounds: int) -> Model:
    """A model of all rows (doc_id, th, text) that are not held out; counts: their words.

    There are as many learners as get ``steps`` steps each; a corpus of fewer has one, which goes through its texts again.
    """
    tokenizer, spark = subwords.value, rows.sparkSession
    times = np.zeros((2, tokenizer.size), np.int64)
    # at most two rows for each id of the tokenizer
    for i, n in counts.mapInArrow(_ids(subwords), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        times[int(i < 0), i if i >= 0 else -1 - i] = n
    ends = counts.where(F.length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    model = new_model(times[0], times[1], ends, tokenizer)
    if not ends:
        return model
    total = (times.sum() / WINDOW + ends) / BATCH
    learners, passes = max(1, int(total // max(1, steps))), max(1, round(steps / total))
    # few enough tasks that what they send is small beside the texts, and enough for all cores
    tasks = min(learners, 4 * spark.sparkContext.defaultParallelism)
    expected = total * passes / learners / rounds
    falling = np.linspace(0.01, 0.0005, rounds + 1).tolist()
    learn = rows.where(~F.col("held_out")).withColumn("order", F.xxhash64("doc_id", "th", F.lit(7)))
    learn = learn.select("text", "order", F.pmod("order", F.lit(rounds)).cast("int").alias("round"), F.pmod(F.xxhash64("doc_id", "th", F.lit(11)), F.lit(learners)).cast("int").alias("learner"))
    texts, path = written(learn, "learn", by="round")
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        dealt = texts.where(F.col("round") == k).select("learner", "text", "order").repartitionById(tasks, F.col("learner") % tasks).sortWithinPartitions("learner", "order").select("learner", "text")
        found = dealt.mapInArrow(_learned(subwords, shared, passes, expected, (falling[k], falling[k + 1]), k, tasks), PIECES)
        # as many pieces as the model has, however many learners there are
        got = sorted((r.piece, r["values"]) for r in averaged(found, tasks).collect())
        shared.unpersist()
        if got:
            flat, at = np.concatenate([np.frombuffer(x, np.float32) for _, x in got]), 0
            for n in Model.NAMES:
                x = model.p[n]
                model.p[n] = flat[at : at + x.size].reshape(x.shape).copy()
                at += x.size
    discard(spark, path)
    return model


class Vocabulary:
    """The words of a block: their counts in the training tokens and their units."""

    def __init__(self, model: Model, subwords: Subwords):
        self.model, self.subwords = model, subwords
        self.number: dict[bytes, int] = {}
        self.counts: list[int] = []
        self.count = np.empty(0, np.int64)
        self.flat, self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.spelling = np.empty(0)

    def add(self, words: list[bytes], counts: np.ndarray) -> None:
        """Words with their counts, before any text's words that have none."""
        for w, c in zip(words, counts.tolist(), strict=True):
            if self.number.setdefault(w, len(self.number)) == len(self.counts):
                self.counts.append(c)

    def counted(self, words: np.ndarray) -> np.ndarray:
        """The counts of words given by number; 0 for those that were not added."""
        if len(self.count) != len(self.counts):
            self.count = np.array(self.counts, np.int64)
        out = np.zeros(len(words), np.int64)
        has = words < len(self.count)
        out[has] = self.count[words[has]]
        return out

    def numbers(self, words: list[bytes]) -> np.ndarray:
        number = self.number
        try:
            return np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        except KeyError:  # words that no training document has
            return np.array([number.setdefault(w, len(number)) for w in words], np.int64)

    def grow(self) -> None:
        """Units of the words that have none yet."""
        old = len(self.size)
        if old == len(self.number):
            return
        u, new = self.model.units, list(islice(self.number, old, None))
        flat, size = self.subwords.ids([w for w in new if w != END])
        first = self.subwords.begins[flat]
        spelled = np.add.reduceat(u.spelling(flat, first).astype(np.float64), np.cumsum(size) - size) if len(size) else np.empty(0)
        flat = u.of(flat, first)
        if END in new:  # the end has no subwords, but one unit
            at = new.index(END)
            flat, size, spelled = np.insert(flat, size[:at].sum(), u.end), np.insert(size, at, 1), np.insert(spelled, at, 0)
        self.spelling = np.concatenate([self.spelling, spelled])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        self.start = np.cumsum(self.size) - self.size

    def spelled(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The units of words given by number, one after another, how many each word has and where they begin."""
        self.grow()
        size = self.size[words]
        at = np.cumsum(size) - size
        return self.flat[np.arange(size.sum()) + np.repeat(self.start[words] - at, size)], size, at


def sequences(texts: Iterable, vocab: Vocabulary, together: int = 150_000) -> Iterator[np.ndarray]:
    """sequence() of each text, with each different word tokenized once."""
    texts, some, size = iter(texts), [], 0
    while True:
        text = next(texts, None)
        if text is not None:
            some.append(vocab.numbers([*words_of(text), END]))
            size += len(some[-1])
        if some and (text is None or size > together):
            seq, n, at = vocab.spelled(np.concatenate(some))
            last = np.cumsum([len(x) for x in some]) - 1
            yield from np.split(seq, (at + n)[last[:-1]])
            some, size = [], 0
        if text is None:
            return


def score_texts(texts: list[np.ndarray], vocab: Vocabulary, total: int, distinct: int, share: float) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score and score of texts given as word numbers, each with its end."""
    n = np.array([len(t) for t in texts])
    first = np.cumsum(n) - n
    words = np.concatenate(texts)
    c = vocab.counted(words)
    seq, size, at = vocab.spelled(words)
    logp, logb = vocab.model.score(seq, np.add.reduceat(size, first))
    # a word is its subwords, given that a word begins, and then that another begins; the end is the last word's other
    after = np.append(logb[at[1:]], 0)
    after[first[1:] - 1] = 0
    own = np.add.reduceat(logp.astype(np.float64), at) + vocab.spelling[words] - logb[at] + after
    mixed = np.log1p(-share) + own
    known = c > 0
    mixed[known] = np.logaddexp(mixed[known], np.log(share * c[known] / max(1, total)))
    base = np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    return n, np.add.reduceat(known.astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(mixed, first) / np.log(10)


COUNT_ARROW = pa.schema([("word", pa.binary()), ("block", pa.int32()), ("n", pa.int64())])
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each block with their count in its training documents (0 for words of the others alone)."""
    counts: dict[int, Counter] = defaultdict(Counter)
    size = 0
    for batch in parts:
        for text, block, held in zip(bytes_of(batch.column(0)), column_np(batch, "block").tolist(), batch.column(2).to_pylist(), strict=True):
            c = counts[block]
            size -= len(c)
            if held:
                for w in words_of(text):
                    c.setdefault(w, 0)
                c.setdefault(END, 0)
            else:
                c.update(words_of(text))
                c[END] += 1
            size += len(c)
            if size > 1_500_000:
                for b, c in counts.items():
                    yield from batches(COUNT_ARROW, [list(c), np.full(len(c), b), np.fromiter(c.values(), np.int64, len(c))])
                counts.clear()
                size = 0
    for b, c in counts.items():
        yield from batches(COUNT_ARROW, [list(c), np.full(len(c), b), np.fromiter(c.values(), np.int64, len(c))])


def _scored(shared, total: int, distinct: int, share: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, subwords = shared.value
        vocab, block = Vocabulary(model, subwords), None
        for batch in parts:
            blocks, has = column_np(batch, "block"), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(batch)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if blocks[lo] != block:
                    vocab, block = Vocabulary(model, subwords), blocks[lo]
                # rows with a word come before rows with a text
                mid = lo + int(has[lo:hi].sum())
                if mid > lo:
                    vocab.add(batch.column(2).slice(lo, mid - lo).to_pylist(), batch.column(3).slice(lo, mid - lo).to_numpy(zero_copy_only=False))
                yield from docs(batch.slice(mid, hi - mid), vocab)

    def docs(batch: pa.RecordBatch, vocab: Vocabulary) -> Iterator[pa.RecordBatch]:
        texts, at, size = [], 0, 0
        for i, text in enumerate(bytes_of(batch.column(6))):
            texts.append(vocab.numbers([*words_of(text), END]))
            size += len(texts[-1])
            if size > 150_000 or i == len(batch) - 1:
                n, known, base, score = score_texts(texts, vocab, total, distinct, share)
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(4), part.column(5), *map(pa.array, (n, known, base, score))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
                texts, at, size = [], i + 1, 0

    return run


def lm_score(docs: DataFrame, mod: int = 10, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, steps: int = STEPS, rounds: int = ROUNDS, share: float = SHARE, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each row of docs.

    Documents whose crc32 of the id as text is divisible by ``mod`` are held out of all learning; the model learns from all
    others, and goes through them again only where all of them together give few of ``steps`` steps. Null and empty texts are one
    end token; null ids count as the empty text; repeated rows count each time and score alike; if nothing is learned, all
    tokens are unknown and the untrained model scores; an empty table gives an empty result.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = ids_and_bytes(slim.select("doc_id", "text"))
    raw = F.when(F.col("doc_id") != (1 << 63) - 1, F.col("doc_id")).cast("string")
    rows = rows.withColumn("held_out", F.crc32(F.coalesce(raw, F.lit("")).cast("binary")) % mod == 0)
    n_blocks = max(1, -(-(slim.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "th"), F.lit(n_blocks)).cast("int"))
    seen = stash(rows.select("text", "block", "held_out").repartitionById(n_blocks, "block").mapInArrow(_counted, "word binary, block int, n long"), "words")
    counts = stash(seen.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    context = docs.sparkSession.sparkContext
    subwords = context.broadcast(Subwords(tokenizer))
    shared = context.broadcast((trained(rows, counts, subwords, steps, rounds), subwords.value))

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    words = seen.join(counts, "word").select("block", F.lit(0).alias("kind"), "word", "c", none("long", "doc_id"), none("boolean", "held_out"), none("binary", "text"))
    texts = rows.select("block", F.lit(1).alias("kind"), none("binary", "word"), none("long", "c"), "doc_id", "held_out", "text")
    work = words.unionByName(texts).repartitionById(n_blocks, "block").sortWithinPartitions("block", "kind")
    out = work.mapInArrow(_scored(shared, total, distinct, share), OUT).withColumn("train_tokens", F.lit(total).cast("long"))
    return with_null_ids(out)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
