"""One consistent form for text that looks the same (problem 5).

Compatibility normalisation in composed form, full case folding, mapped white
space, removal of default-ignorable characters and of look-alikes from other
scripts, done once per distinct value of a batch.  A table over all code points
finds the values that need a closer look; the rest passes in array operations.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import spread
from . import flat

# The part of plane 14 that does not show, assigned or not (tags, further variation selectors).
PLANE_14 = range(0xE0000, 0xE1000)
# Characters that do not show (Default_Ignorable_Code_Point, and controls besides tabs and line ends).
IGNORABLE = (
    *range(0x00, 0x09), *range(0x0E, 0x20), *range(0x7F, 0x85), *range(0x86, 0xA0), 0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810),
    *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xFFF0, 0xFFFC),
    *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *PLANE_14,
)
# Letters of other scripts and the Latin letters they look like, capitals first.
LOOKALIKES_FROM = "АВСЕНІЈКМОРЅТУХԚԜасеһіјорԛѕԝухΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινυՕօՍսոհ"
LOOKALIKES_TO = "ABCEHIJKMOPSTYXQWacehijopqswyxABEZHIKMNOPTYXoivuOoUunh"
# Further letters that resemble Latin ones, in words that also hold Latin letters; genuine words may consist of them.
MIXED_FROM = "αγκρχϳϜϺԁѵӏӀүһгѡьЬԌёїӑӓѐӧӱգզռցքյՏԼᎪᎬᎻᎷᎫᏀᏃᏚᏙᏞᏟᏢᏦᎢᎳᏴᎠᎡᎥᏏⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲥⲣⲓꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
MIXED_TO = "aykpxjFMdvlIyhrwbbGëïăäèöÿqqngfjSLAEHMJGZSVLCPKTWBDRibABEHIKMNOPCTYXocpiBPDTGKJCZFMNLSRVHWXYAEIOU"
# Latin letters of phonetic alphabets that resemble plain ones, in words whose other letters are plain.
PHONETIC_FROM, PHONETIC_TO = "ɑɡɩʋ", "agiv"
# Persian and Urdu letters and digits, and the Arabic ones they look like.
PERSIAN_FROM = "یکہھەۃ۰۱۲۳۴۵۶۷۸۹"
PERSIAN_TO = "يكهههة٠١٢٣٤٥٦٧٨٩"
# Kinds of compatibility characters that look like what they stand for.
SAME_LOOKING = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<font>")
# Ligatures and roman numerals among the other compatibility characters.
LIGATURES = (*range(0xFB00, 0xFB50), 0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0x2160, 0x2180))

_TO_LATIN = dict(zip(LOOKALIKES_FROM, LOOKALIKES_TO, strict=True))
_TO_LATIN_MIXED = dict(zip(MIXED_FROM, MIXED_TO, strict=True)) | _TO_LATIN
for _a, _b in list(_TO_LATIN_MIXED.items()):  # the form must not depend on case: a capital without a double takes its small letter's
    if len(_a.upper()) == 1:
        _TO_LATIN_MIXED.setdefault(_a.upper(), _b.upper())
_FROM_LATIN = {"CYRILLIC": {}, "GREEK": {}}
for _a, _b in (*_TO_LATIN.items(), *((a, b) for a, b in zip(MIXED_FROM, MIXED_TO, strict=True) if b not in _TO_LATIN.values())):
    _FROM_LATIN.setdefault(unicodedata.name(_a).split(" ", 1)[0], {}).setdefault(_b, _a)
_TO_ARABIC = str.maketrans(PERSIAN_FROM, PERSIAN_TO)
_HIDDEN = dict.fromkeys(IGNORABLE)
_SPACES = str.maketrans({chr(i): " " for i in range(0x3001) if unicodedata.category(chr(i)) == "Zs"})
_RUN = re.compile(r"[^\W\d_]+")
_OTHER_SCRIPT = re.compile(f"[\u0370-\u058f\u13a0-\u13ff\u1f00-\u1fff\u2c60-\u2dff\ua4d0-\ua4ff\ua640-\ua69f\uab70-\uabbf{PHONETIC_FROM}]")
_PHONETIC = str.maketrans(PHONETIC_FROM, PHONETIC_TO)
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU")
_PERSIAN = re.compile(f"[{PERSIAN_FROM}]")
_UNSHOWN = re.compile(f"[{chr(PLANE_14[0])}-{chr(PLANE_14[-1])}" + "".join(map(re.escape, map(chr, (*(i for i in IGNORABLE if i not in PLANE_14), *map(ord, (c for c in map(chr, range(0x3001)) if unicodedata.category(c) == "Zs" and c != " ")))))) + "]")

_UNSHOWN_MAP = _HIDDEN | _SPACES


def _shown(text: str) -> str:
    """Without the characters that do not show, and with plain blanks."""
    return text.translate(_UNSHOWN_MAP) if _UNSHOWN.search(text) else text


PLAIN, STANDS_IN, LOOK_CLOSER = 0, 1, 2


@functools.lru_cache(1)
def kinds() -> np.ndarray:
    """For each code point: plain; certainly no part of the consistent form; or in need of its surroundings."""
    out = np.zeros(flat.TABLE, np.uint8)
    composing = {c for i in range(flat.TABLE) if len(d := unicodedata.normalize("NFD", chr(i))) > 1 and unicodedata.normalize("NFC", d) == chr(i) for c in d[1:]}
    for i in range(flat.TABLE):
        ch = chr(i)
        tag = unicodedata.decomposition(ch).split(" ", 1)[0]
        if tag in SAME_LOOKING or (tag and tag[0] != "<" and unicodedata.normalize("NFC", ch) != ch):
            out[i] = STANDS_IN
        elif unicodedata.category(ch) == "Zs" and ch != " ":
            out[i] = STANDS_IN
        elif ch in composing or ch in PHONETIC_FROM or any(x in unicodedata.name(ch, "") for x in SCRIPTS[1:]):
            out[i] = LOOK_CLOSER
        elif unicodedata.category(ch) == "Nd" and not (ch.isascii() or 0x660 <= i < 0x66A):
            out[i] = STANDS_IN
    out[[i for i in IGNORABLE if i < flat.TABLE]] = STANDS_IN
    out[list(LIGATURES)] = STANDS_IN
    out[[ord(c) for c in PERSIAN_FROM]] = STANDS_IN
    return out


def kinds_of(points: np.ndarray) -> np.ndarray:
    """`kinds` of each code point, also of those beyond the table."""
    out = flat.look_up(kinds(), points)
    if len(points) and points.max() >= PLANE_14[0]:
        out[(points >= PLANE_14[0]) & (points <= PLANE_14[-1])] = STANDS_IN
    return out


def script(ch: str) -> str:
    name = unicodedata.name(ch, "").split(" ", 1)[0]
    return name if name in SCRIPTS else ""


def _word(word: str) -> str:
    """A word in one script: that of its letters without a double, else the one most of its letters are of, else Latin."""
    scripts = [script(c) for c in word]
    present = set(scripts) - {""}
    if not present:
        return word
    if present == {"LATIN"}:
        plain = word.translate(_PHONETIC)
        return plain if plain.isascii() and any(c.isascii() for c in word) else word
    if len(present) == 1:
        return "".join(map(_TO_LATIN.__getitem__, word)) if all(c in _TO_LATIN for c in word) else word
    if "LATIN" not in present:
        return word
    other = max(present - {"LATIN"}, key=scripts.count)
    doubles = _TO_LATIN if other in SCRIPTS[1:4] else _TO_LATIN_MIXED  # of the rarer scripts, only letters without any double tell
    own = [c for c, s in zip(word, scripts, strict=True) if s == other and c not in doubles]
    if own and scripts.count(other) >= scripts.count("LATIN"):
        return "".join(_FROM_LATIN[other].get(c, c) if s == "LATIN" else c for c, s in zip(word, scripts, strict=True))
    return "".join(_TO_LATIN_MIXED.get(c, c) for c in word)


def one_script(text: str) -> str:
    return _RUN.sub(lambda m: _word(m[0]), text) if _OTHER_SCRIPT.search(text) else text


def canonical(text: str) -> str:
    """The consistent form of a value: composed, case-folded, plain blanks, nothing hidden, one script to a word."""
    if text.isascii() and text.isprintable():
        return text.lower()
    text = one_script(unicodedata.normalize("NFKC", _shown(text)))
    if _PERSIAN.search(text):
        text = text.translate(_TO_ARABIC)
    return _shown(unicodedata.normalize("NFKC", text.casefold()))


def settled(text: str) -> str:
    """`canonical` of a value that has no character to replace or to remove."""
    if text.isascii():
        return text.lower()
    text = text.casefold()
    return text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


def stands_in(text: str) -> bool:
    """Whether a value holds a split letter or a look-alike: the part of the question that needs surroundings."""
    return len(unicodedata.normalize("NFC", text)) != len(text) or one_script(text) != text


def canonicalize(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, canonical, changed): the consistent form of each value, and whether the value was not in it.

    changed tells of characters that do not show or that stand for others they look like, also where the value holds
    nothing else.  Case, vowel marks, kashida, line breaks and words of other scripts are no such characters.
    NULL stays NULL and is unchanged; an empty value stays empty.  Rows are kept as they are, also repeated ones.
    """
    narrow = spread(df.select(*keys, F.col(value).cast("string").alias("value")))
    n_keys = len(keys)

    def run(batches):
        for batch in batches:
            coded = pc.dictionary_encode(batch.column(n_keys))
            distinct = coded.dictionary
            forms, odd = [], []
            text = flat.strings(distinct)
            for a, b in flat.slices(text):
                part = text.slice(a, b - a)
                points, rows = flat.code_points(part)
                kind = kinds_of(points)
                sure = np.diff(np.concatenate(([0], np.cumsum(kind == STANDS_IN)))[rows]) > 0
                open_ = (np.diff(np.concatenate(([0], np.cumsum(kind == LOOK_CLOSER)))[rows]) > 0) & ~sure
                values = part.to_pylist()
                for i in np.flatnonzero(open_).tolist():
                    sure[i] = stands_in(values[i])
                odd.append(sure)
                # A value without a character to replace only needs composing and folding.
                forms.extend(canonical(v) if s else settled(v) for v, s in zip(values, sure.tolist(), strict=True))
            changed = pa.array(np.concatenate(odd) if odd else np.zeros(0, bool))
            at = coded.indices
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_keys], pa.array(forms, pa.string()).take(at), pc.fill_null(changed.take(at), False)], [*keys, "canonical", "changed"]
            )

    schema = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys)
    return narrow.mapInArrow(run, f"{schema}, canonical string, changed boolean")


def stored_values(generation: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(tbl, record_id, lang, value) of the columns that are compared as text."""
    parts = [
        generation.select(F.lit("generation").alias("tbl"), F.col("gen_id").cast("string").alias("record_id"), "lang", F.col("answer").alias("value")),
        *(questions.select(F.lit("questions").alias("tbl"), F.col("qid").alias("record_id"), F.lit(x).alias("lang"), F.col(f"answer.{x}").alias("value")) for x in ("en", "ar")),
        chunks.select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("record_id"), F.lit("ar").alias("lang"), F.col("ar").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
