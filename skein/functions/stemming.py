"""English stems by the published Porter2 rules. Words repeat, so each batch stems its different words once."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Fixed values of the published algorithm.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
FINISHED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f"{_VOWEL}{_OTHER}")
_SHORT = re.compile(f"(?:{_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$")


def _after(word: str, start: int) -> int:
    """Where the region begins that follows the first consonant after a vowel."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


@lru_cache(1 << 16)
def stem_word(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2 or word in UNCHANGED:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    # a y that begins the word or follows a vowel is a consonant
    w = re.sub(r"(?:^|(?<=[aeiouy]))y", "Y", word)
    begin = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = begin if begin is not None else _after(w, 0)
    r2 = _after(w, r1)

    def ends(*endings: str) -> str:
        return next((e for e in endings if w.endswith(e)), "")

    if e := ends("sses", "ied", "ies", "us", "ss", "s"):
        if e == "sses":
            w = w[:-2]
        elif e in ("ied", "ies"):
            w = w[:-2] if len(w) > 4 else w[:-1]
        elif e == "s" and re.search(_VOWEL, w[:-2]):
            w = w[:-1]
    if w in FINISHED:
        return w
    if e := ends("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if e.startswith("eed"):
            w = w[: -len(e)] + "ee" if len(w) - len(e) >= r1 else w
        elif re.search(_VOWEL, w[: -len(e)]):
            w = w[: -len(e)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _SHORT.search(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    if (e := ends(*STEP_2)) and len(w) - len(e) >= r1:
        before = w[: -len(e)]
        if not (e == "ogi" and not before.endswith("l") or e == "li" and before[-1:] not in set("cdeghkmnrt")):
            w = before + STEP_2[e]
    if (e := ends(*STEP_3)) and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + STEP_3[e]
    if (e := ends(*STEP_4)) and len(w) - len(e) >= r2 and (e != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    return words.map({w: stem_word(w) for w in words.dropna().unique()})
