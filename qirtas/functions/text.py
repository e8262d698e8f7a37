"""Text normalisation and comparison as Spark columns.

Everything but the compatibility normalisation is a built-in expression; that one step is an Arrow UDF that only
looks at texts with characters beyond ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LANGS = ("en", "ar")

# The digits, marks and letters that normalisation folds, the articles and clitics it strips.
DIGITS_FROM = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
DIGITS_TO = "01234567890123456789"
ARABIC_MARKS = "[\u064b-\u065f\u0670\u0640]"
LETTERS_FROM = "آأإٱةى"
LETTERS_TO = "ااااهي"
DEFINITE_PREFIXES = ("وال", "بال", "كال", "فال", "لل", "ال")
ARTICLES = ("a", "an", "the")
CONJUNCTIONS = ("و", "ف")

DIGIT_MAP = str.maketrans(DIGITS_FROM, DIGITS_TO)
_FOLD = str.maketrans(LETTERS_FROM, LETTERS_TO, "".join(map(chr, [*range(0x64B, 0x660), 0x670, 0x640])))

WORD = r"[\p{L}\p{N}_]+"


def fold_arabic(text: str) -> str:
    return text.translate(_FOLD)


def normalize(text: str, lang: str) -> str:
    """The normal form of one Python string; the column form below gives the same."""
    if lang not in LANGS:
        raise ValueError(f"no normalisation for language {lang!r}")
    text = unicodedata.normalize("NFKC", text).translate(DIGIT_MAP).lower()
    return " ".join((fold_arabic(text) if lang == "ar" else text).split())


def _composed(form: str):
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([unicodedata.normalize(form, x) if isinstance(x, str) and not x.isascii() else x for x in values], dtype=object)

    return run


def unicode_form(c: Column, form: str = "NFKC") -> Column:
    """Unicode normal form; ASCII texts never leave the JVM's value untouched."""
    return _composed(form)(c)


def fold(c: Column, lang: str) -> Column:
    """Normal form of a text that is already NFKC: digits, case, Arabic marks and letters, white space; NULL stays NULL."""
    if lang not in LANGS:
        raise ValueError(f"no normalisation for language {lang!r}")
    c = F.lower(F.translate(c, DIGITS_FROM, DIGITS_TO))
    if lang == "ar":
        c = F.translate(F.regexp_replace(c, ARABIC_MARKS, ""), LETTERS_FROM, LETTERS_TO)
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+", " "))


def normalized(c: Column, lang: str) -> Column:
    return fold(unicode_form(c), lang)


def words(c: Column) -> Column:
    """The words of a normalised text: runs of letters, digits and underscores."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def tokens(c: Column, lang: str) -> Column:
    return words(normalized(c, lang))


def _without_article(token: Column) -> Column:
    out = token
    for prefix in reversed(DEFINITE_PREFIXES):
        out = F.when(token.startswith(prefix) & (F.length(token) >= len(prefix) + 2), token.substr(F.lit(len(prefix) + 1), F.length(token))).otherwise(out)
    return out


def content_tokens(toks: Column, lang: str) -> Column:
    """Tokens of a short answer: English articles go, the Arabic article is cut off where two letters stay.

    As all expressions that look into arrays, it wants a column of tokens, not the normalisation itself: Spark does not
    evaluate a Python function within a higher-order one.
    """
    if lang == "en":
        return F.filter(toks, lambda t: ~t.isin(*ARTICLES))
    return F.transform(toks, _without_article)


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    return F.aggregate(
        F.array_distinct(a), F.lit(0), lambda acc, t: acc + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t)))
    )


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token arrays: 1 if both are empty, 0 if one is."""
    both = overlap(a, b).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), ((F.size(a) == 0) & (F.size(b) == 0)).cast("double")).otherwise(
        F.try_divide(2 * both, (F.size(a) + F.size(b)).cast("double"))
    )


def _framed(toks: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))


def contains_span(hay: Column, needle: Column) -> Column:
    """Whether one token array stands in another as a run of whole tokens; an empty one never does."""
    return (F.size(needle) > 0) & F.contains(_framed(hay), _framed(needle))


def _without_conjunction(toks: Column) -> Column:
    return F.transform(toks, lambda t: F.when((F.length(t) >= 3) & t.substr(1, 1).isin(*CONJUNCTIONS), t.substr(F.lit(2), F.length(t))).otherwise(t))


def contains_evidence(hay: Column, needle: Column, lang: str) -> Column:
    """`contains_span`, forgiving a conjunction (Arabic) or lost blanks in five tokens and more (English)."""
    if lang == "ar":
        return contains_span(hay, needle) | contains_span(_without_conjunction(hay), _without_conjunction(needle))
    return contains_span(hay, needle) | ((F.size(needle) >= 5) & F.contains(F.array_join(hay, ""), F.array_join(needle, "")))


def abstains(answer: Column, condition: Column) -> Column:
    """Whether an answer declines, by the token its condition asks for; NULL counts as no answer given, not as declining."""
    said = F.upper(F.coalesce(answer, F.lit("")))
    return F.when(condition == "closed_book", F.contains(said, F.lit("UNKNOWN"))).otherwise(F.contains(said, F.lit("NOT_IN_CONTEXT")))
