"""Small corpora with the awkward cases: nulls, empty and long texts, ties, repeated rows, copies and shared passages."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(["an", "er", "in", "th", "ou", "é", "ß", "st"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    def prose(k):
        out = " ".join(r.choice(vocabulary) for _ in range(k))
        return out.replace(" ", "\n", 3) if r.random() < 0.5 else out
    passage, texts = prose(120), []
    for i in range(n):
        t = prose(r.choice([0, 1, 3, 4, 5, 12, 40, 130, 260]))
        if i % 7 == 3:
            t = f"{t} {passage} {prose(30)}"
        if i % 11 == 5 and texts:
            t = r.choice(texts)
        if i % 13 == 6 and texts:
            w = r.choice(texts).split()
            if w:
                w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        texts.append(t)
    texts += [None, "", "  \n\t ", "A", "a", "!!! ??? 123", "a a a a", "x" * 900, passage + passage, texts[5] + " ", prose(3000), None]
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["a", "b", "ä", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[3], "en", "a", 1)]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(5)


def as_tables(spark, path, rows, **others):
    """Writes documents (and others: name -> DataFrame) as Parquet; returns the folder."""
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    for name, df in others.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)
