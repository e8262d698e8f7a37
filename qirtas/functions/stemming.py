"""Light Arabic stemming as a column expression, and the Porter2 English stemmer for distinct terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Clitics stripped from the front (the first that fits) and endings from the back (each that fits, in order).
ARABIC_PREFIXES = ("ال", "وال", "بال", "كال", "فال", "لل", "و")
ARABIC_SUFFIXES = ("ها", "ان", "ات", "ون", "ين", "يه", "ية", "ه", "ة", "ي")


def stem_arabic(word: Column) -> Column:
    """One prefix where two letters stay (three after a single letter), then every suffix where two letters stay."""
    stem = F.coalesce(
        *(F.when(word.startswith(p) & (F.length(word) >= (4 if len(p) == 1 else len(p) + 2)), word.substr(F.lit(len(p) + 1), F.length(word))) for p in ARABIC_PREFIXES), word
    )
    return F.aggregate(
        F.array(*map(F.lit, ARABIC_SUFFIXES)), stem, lambda w, s: F.when((F.length(w) >= F.length(s) + 2) & w.endswith(s), w.substr(F.lit(1), F.length(w) - F.length(s))).otherwise(w)
    )


def light_arabic(word: str) -> str:
    """`stem_arabic` of one Python string."""
    for p in ARABIC_PREFIXES:
        if word.startswith(p) and len(word) >= (4 if len(p) == 1 else len(p) + 2):
            word = word[len(p) :]
            break
    for s in ARABIC_SUFFIXES:
        if word.endswith(s) and len(word) >= len(s) + 2:
            word = word[: -len(s)]
    return word


# Fixed values of the published Porter2 algorithm: its word lists and endings.
_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    """Where the regions R1 and R2 of the published description begin."""
    starts = []
    at = 0
    for k in range(2):
        if k == 0 and (m := re.match("gener|commun|arsen", w)):
            at = m.end()
        else:
            m = re.compile("[aeiouy][^aeiouy]").search(w, at)
            at = m.end() if m else len(w)
        starts.append(at)
    return starts[0], starts[1]


def _short_end(w: str) -> bool:
    return bool(re.search(r"(?:^|[^aeiouy])[aeiouy][^aeiouywxY]$", w)) if len(w) > 2 else bool(re.fullmatch(r"[aeiouy][^aeiouy]", w))


def porter2(word: str) -> str:
    """Stem of a lower-case English word; words of up to two letters and words of other letters stay."""
    if word in _SPECIAL:
        return _SPECIAL[word]
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    ending = next((s for s in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(s)), "")
    if ending in ("eed", "eedly"):
        if len(w) - len(ending) >= r1:
            w = w[: -len(ending)] + "ee"
    elif ending and re.search("[aeiouy]", w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif _short_end(w) and len(w) <= r1:
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # 2
    for s, to in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + to
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] and w[-3] in _LI:
            w = w[:-2]
    # 3
    for s, to in (*_STEP3, ("ative", None)):
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if to is None else r1):
                w = w[: -len(s)] + (to or "")
            break
    # 4
    for s in sorted((*_STEP4, "ion"), key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(StringType())
def stem_english(words: pd.Series) -> pd.Series:
    """Porter2, once per distinct word of a batch."""
    stems = {w: porter2(w) for w in words.dropna().unique()}
    return pd.Series([stems.get(w) for w in words], dtype=object)
