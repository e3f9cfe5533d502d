"""The parsers against plain Python readings of their rules, on hand-made and generated texts."""

import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import parsers as p
from skein.functions.stemming import stem, stem_word
from skein.functions.text import cover_density, web_query

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, texts, make, schema="x string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, {schema}")
    return [r[0] for r in rows.select(make(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def invoices_by_hand(note):
    """Character by character, without regular expressions."""
    note, out, i = note or "", [], 0
    digit = lambda k: 0 <= k < len(note) and note[k] in "0123456789"
    while i < len(note):
        if not digit(i):
            i += 1
            continue
        j = i
        while digit(j):
            j += 1
        glued = (i > 1 and note[i - 1] in ".,/-" and digit(i - 2)) or (j < len(note) and note[j] in ".,/-" and digit(j + 1))
        money = note[:i].rstrip().endswith("$")
        tagged = note[:i].endswith("#") or note[:i].endswith("# ")
        n = int(note[i:j])
        if not glued and not money and 1002 <= n <= 19999 and (tagged or not 2018 <= n <= 2031):
            out.append(n)
        i = j
    return out


NOTES = ["#4556", "# 4556", "4556.", "4556.50", ".50", "1,234", "$ 4500", "3/15/2021", "2021-03-15", "4556-4557", "in 2020", "#2020", "1001", "1002", "19999", "20000", "", None, "4556 4556", "$x 4556", "#  2020", "9" * 40]


def test_invoice_numbers(spark):
    assert column(spark, NOTES, p.invoice_numbers) == [invoices_by_hand(n) for n in NOTES]


@QUICK
@given(st.lists(st.text(alphabet="0124589 #$.,/-x\t", max_size=25), min_size=60, max_size=120))
def test_invoice_numbers_generated(spark, notes):
    assert column(spark, notes, p.invoice_numbers) == [invoices_by_hand(n) for n in notes]


def test_square_feet(spark):
    got = column(spark, ["72", "72.5", "72 sf", " 72 ", "$72", "72 sq. ft.", "72FT2", "72 ft.", "", None, "abc", "72 x 3"], p.square_feet)
    assert [tuple(r) for r in got] == [(72, False), (72.5, False)] + [(72, False)] * 6 + [(None, False)] * 2 + [(None, True)] * 2


def test_line_items(spark):
    got = column(spark, ["Top x2 $1,500.00 | cut off… | A x B x3.0 $-9", "Fee $0.00", "Zero x0 $5", "", None], p.line_items)
    assert [tuple(r) for r in got[0]] == [(1, "Top", 2.0, 750.0, 1500.0, False), (2, None, None, None, None, True), (3, "A x B", 3.0, -3.0, -9.0, False)]
    assert [tuple(r) for r in got[1]] == [(1, "Fee", None, None, 0.0, False)]
    assert [tuple(r) for r in got[2]] == [(1, "Zero", 0.0, None, 5.0, False)]
    assert got[3:] == [[], []]


def test_assignee_and_form_ids(spark):
    names = ["Ann", "Zoë", "x" * 100]
    want = [int.from_bytes(hashlib.sha1(n.encode()).digest()[:8], "big") & (2**63 - 1) for n in names]
    assert column(spark, names, p.assignee_id) == want
    row = spark.range(1).select(p.form_id(F.lit(None).cast("bigint"), F.lit(12), F.lit(3)), p.form_id(F.lit(9), F.lit(12), F.lit(3))).first()
    assert tuple(row) == (-12003, 9)


def test_text_hash_and_tokens(spark):
    want = hashlib.sha256(("note" + hashlib.sha256(b"facts").hexdigest()).encode()).hexdigest()
    assert column(spark, ["note"], lambda c: p.text_hash(c, F.lit("facts"))) == [want]
    assert column(spark, ["abcdefg", ""], p.token_estimate) == [1, 0]


def test_numbers(spark):
    cases = {
        "": [], "none": [], "1,198 jobs": [(1198.0, False)], "$2.59M": [(2590000.0, True)], "3k and 4 B": [(3000.0, True), (4e9, True)], "-3.5": [(-3.5, False)], "1-2": [(1.0, False), (-2.0, False)],
        "5.": [(5.0, False)], "7 Mb": [(7.0, False)], "12,34,5": [(12345.0, False)], "0.10 m": [(100000.0, True)], "in 2024, 6 of 9": [(2024.0, False), (6.0, False), (9.0, False)],
    }
    assert {t: [tuple(n) for n in r] for t, r in zip(cases, column(spark, list(cases), p.numbers))} == cases


def test_numeric_match(spark):
    pairs = [("1,198", "it is 1198", True), ("$2.59M", "2,591,000", True), ("2.59M", "2.7M", False), ("72.5", "72.9", True), ("72.5", "73.1", False), ("3", "3.2", True), ("3", "4", False), ("3, 4", "4 then 3", True), ("3, 4", "4", False), ("none", "7", None), ("5", "none", False), ("-3", "-3", True)]
    rows = spark.createDataFrame(pairs, "e string, a string, want boolean").withColumn("got", p.numeric_match(F.col("e"), F.col("a"))).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_zip_codes(spark):
    areas, typos = F.create_map(F.lit("29407"), F.lit("A"), F.lit("29412"), F.lit("B")), F.create_map(F.lit("299407"), F.lit("29407"))
    got = column(spark, ["299407", "29412-1234", "294", None, "", "29412 "], lambda c: p.clean_zip(c, areas, typos))
    assert got == ["29407", "29412", None, None, None, "29412"]
    assert column(spark, ["City 29412", "29412-1234 or 29407", "none"], lambda c: p.resolve_zip(F.lit("bad"), c, areas, typos)) == ["29412", "29412", None]


def test_long_enough(spark):
    assert column(spark, ["a" * 25, " " * 30 + "short", "a" * 24 + "\n\n", None], p.long_enough) == [True, False, False, False]


#: Words and stems of the published description of the stemming rules, and words that each rule concerns.
STEMS = {
    "consist": "consist", "consisted": "consist", "consistency": "consist", "consisting": "consist", "consistently": "consist", "consolation": "consol", "console": "consol", "consolidate": "consolid",
    "conspicuous": "conspicu", "conspiracy": "conspiraci", "constable": "constabl", "constant": "constant", "knack": "knack", "knavish": "knavish", "knees": "knee", "knights": "knight", "knives": "knive",
    "knocking": "knock", "knowledge": "knowledg", "generate": "generat", "generically": "generic", "generous": "generous", "skies": "sky", "dying": "die", "news": "news", "proceed": "proceed", "ties": "tie", "cries": "cri",
    "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "luxuriated": "luxuri", "hopping": "hop", "hoping": "hope", "sized": "size", "agreed": "agre", "feed": "feed", "cry": "cri", "by": "by", "say": "say", "rational": "ration",
    "relational": "relat", "happiness": "happi", "hopefully": "hope", "electrical": "electr", "adoption": "adopt", "rate": "rate", "controll": "control", "yesterday": "yesterday", "tops": "top", "classes": "class", "city": "citi",
}


def test_stem(spark):
    assert {w: stem_word(w) for w in STEMS} == STEMS
    assert column(spark, [*STEMS, None], stem) == [*STEMS.values(), None]


def test_web_query():
    got = [(c.phrases, c.negated) for c in web_query('quartz "sink cutout" or edge -granite or')]
    assert got == [((("quartz",),), False), ((("sink", "cutout"), ("edge",)), False), ((("granite",),), True)]
    assert web_query("  or - ") == []


def test_cover_density(spark):
    def density(n, *places):
        rows = spark.createDataFrame([([(x, k) for x, k in places],)], "h array<struct<pos int, nth int>>")
        return rows.select(cover_density(F.col("h"), F.lit(n))).first()[0]

    # a at 1 and 10, b at 3: the covers are [1, 3] with one other word and [3, 10] with six
    assert abs(density(2, (1, 0), (3, 1), (10, 0)) - 0.1 * (1 / 2 + 1 / 7)) < 1e-12
    # a second b inside a cover is no other word
    assert abs(density(3, (1, 0), (2, 1), (3, 1), (4, 2)) - 0.1) < 1e-12
    assert density(1, (1, 0), (5, 0), (6, 0)) == 0.1 + 0.1 + 0.1 and density(2, (1, 0), (4, 0)) == 0
