"""Text normalisation as DuckDB SQL, for the oracles.

Compatibility normalisation is not a function there.  It is put together from its definition: each character's own
compatibility form, then canonical composition.
"""

from __future__ import annotations

import functools
import unicodedata

from ..functions import text as T

WORD = T.WORD


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@functools.lru_cache(1)
def _compatibility() -> tuple[str, str, list[tuple[str, str]]]:
    """(characters, their one-character forms, the rest with their longer forms), for characters texts are likely to hold."""
    one_from, one_to, more = [], [], []
    for i in [*range(0xA0, 0x250), *range(0x2000, 0x2200), *range(0xFB00, 0x10000), 0x3000]:
        ch = chr(i)
        form = unicodedata.normalize("NFKC", ch)
        if form != ch and unicodedata.decomposition(ch).startswith("<"):
            if len(form) == 1:
                one_from.append(ch)
                one_to.append(form)
            else:
                more.append((ch, form))
    return "".join(one_from), "".join(one_to), more


def nfkc(expr: str) -> str:
    one_from, one_to, more = _compatibility()
    common = [m for m in more if m[0] in "…ﬀﬁﬂﬃﬄﬅﬆﻵﻶﻷﻸﻹﻺﻻﻼ½¼¾№™"]
    for ch, form in common:
        expr = f"replace({expr}, {quote(ch)}, {quote(form)})"
    return f"nfc_normalize(translate({expr}, {quote(one_from)}, {quote(one_to)}))"


def normal(expr: str, lang: str) -> str:
    out = f"lower(translate({nfkc(f'coalesce({expr}, {quote('')})')}, {quote(T.DIGITS_FROM)}, {quote(T.DIGITS_TO)}))"
    if lang == "ar":
        out = f"translate(regexp_replace({out}, '[\\x{{64b}}-\\x{{65f}}\\x{{670}}\\x{{640}}]', '', 'g'), {quote(T.LETTERS_FROM)}, {quote(T.LETTERS_TO)})"
    return f"trim(regexp_replace({out}, '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g'))"


def words(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{WORD}')"


def raw_tokens(expr: str) -> str:
    return words(f"lower(nfc_normalize(coalesce({expr}, '')))")


def tokens(expr: str, lang: str) -> str:
    return words(normal(expr, lang))


def content(expr: str, lang: str) -> str:
    """Answer tokens of a list of tokens."""
    if lang == "en":
        return f"list_filter({expr}, lambda t: t NOT IN ('a', 'an', 'the'))"
    cases = " ".join(f"WHEN starts_with(t, {quote(p)}) AND length(t) >= {len(p) + 2} THEN substr(t, {len(p) + 1})" for p in T.DEFINITE_PREFIXES)
    return f"list_transform({expr}, lambda t: CASE {cases} ELSE t END)"


def overlap(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda t: least(len(list_filter({a}, lambda x: x = t)), len(list_filter({b}, lambda x: x = t))))), 0)"


def f1(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE 0.0 END ELSE 2.0 * {overlap(a, b)} / (len({a}) + len({b})) END"
