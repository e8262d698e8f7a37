"""Grouped numbers: finding them, auditing and repairing how the other language writes them.

A number is found as a whole first (digits with their inner points and commas) and judged then, so no pattern needs
to look around itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of three scripts, and the blanks that may stand between digit groups.
DIGIT = "[0-9٠-٩۰-۹]"
BLANK = "[ \\u00a0\\u2002-\\u200a\\u202f]"
FORMS = ("forward_space", "reversed_space", "comma", "joined")


def english_numbers(text: Column) -> Column:
    """Numbers with thousands separators, as written; a decimal part is no part of them."""
    whole = F.regexp_extract_all(text, F.lit("[0-9]+(?:[.,][0-9]+)*"), F.lit(0))
    return F.transform(F.filter(whole, lambda x: x.rlike("^[0-9]{1,3}(?:,[0-9]{3})+(?:[.].*)?$")), lambda x: F.substring_index(x, ".", 1))


def has_thousands(text: Column) -> Column:
    return F.size(english_numbers(text)) > 0


def has_grouped(text: Column) -> Column:
    """Whether a text has a number grouped by commas or blanks, in any of three digit scripts."""
    return text.rlike(f"(?<!{DIGIT})(?<![.,]){DIGIT}{{1,3}}(?:(?:,|{BLANK}){DIGIT}{{3}})+(?!{DIGIT}|,{DIGIT})")


def written_as(number: Column, normal: Column) -> Column:
    """How a normalised text writes an English number: one of FORMS, ambiguous, or not_found."""
    groups = F.split(number, ",")
    texts = (F.array_join(groups, " "), F.array_join(F.reverse(groups), " "), number, F.array_join(groups, ""))
    there = [F.regexp_like(normal, F.concat(F.lit("(^|[^0-9])"), t, F.lit("([^0-9]|$)"))) for t in texts]
    first = F.coalesce(*(F.when(x, F.lit(name)) for x, name in zip(there, FORMS, strict=True)), F.lit("not_found"))
    return F.when(there[0] & there[1], "ambiguous").otherwise(first)


def _reversed_form(number: Column) -> Column:
    """Pattern of a number's groups in reverse order, digits of any script, blanks captured between them."""
    digits = F.transform(F.reverse(F.split(number, ",")), lambda g: F.concat(F.lit("("), F.regexp_replace(g, "([0-9])", "[$1#$1]"), F.lit(")")))
    pattern = F.array_join(digits, f"({BLANK}+)")
    for d in range(10):  # "[3#3]" stands for the digit in its three scripts
        pattern = F.replace(pattern, F.lit(f"[{d}#{d}]"), F.lit(f"[{d}{chr(0x660 + d)}{chr(0x6F0 + d)}]"))
    return F.concat(F.lit(f"(?<!{DIGIT})(?<!{DIGIT}{BLANK})"), pattern, F.lit(f"(?!{BLANK}*{DIGIT})"))


def repair(english: Column, other: Column) -> Column:
    """(text, n): the other text with digit groups put in order where the English one has the number, and how many were.

    Longer numbers come first; numbers that read the same in both orders stay; scripts and blanks are kept.
    """
    numbers = F.filter(F.array_distinct(english_numbers(english)), lambda x: F.array_join(F.reverse(F.split(x, ",")), ",") != x)
    ordered = F.array_sort(F.transform(numbers, lambda x: F.struct((-F.size(F.split(x, ","))).alias("k"), F.split(x, ",").alias("g"), x.alias("x"))))
    most = 6  # groups of a number; more would exceed 10 ** 18

    def put_in_order(size: int) -> str:
        # captured: group, blank, group, ...; the groups are written backwards, the blanks stay
        return "".join(f"${2 * (size - 1 - i) + 1}" + (f"${2 * i + 2}" if i < size - 1 else "") for i in range(size))

    def one(acc: Column, n: Column) -> Column:
        pattern = _reversed_form(n["x"])
        size = F.size(n["g"])
        text = acc["text"]
        changed = text
        for k in range(2, most + 1):
            changed = F.when(size == k, F.regexp_replace(text, pattern, F.lit(put_in_order(k)))).otherwise(changed)
        return F.struct(changed.alias("text"), (acc["n"] + F.regexp_count(text, pattern)).alias("n"))

    return F.aggregate(ordered, F.struct(other.alias("text"), F.lit(0).alias("n")), one)
