"""Document symbols in text, and the keys documents are filed under."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of symbols, and of the short forms of two bodies' resolutions.
SYMBOL = r"(?<![\p{L}\p{N}_/])[A-Z][A-Z-]{0,11}(?:/[A-Za-z0-9.()\-]+)+"
JOINT = r"-(?=[A-Z][A-Z-]{0,11}/)"
ASSEMBLY = r"\bresolutions?\s+((?:4|5|6)\d/\d{1,3})\b"
COUNCIL = r"\bresolutions?\s+(\d{3,4})\s*\(((?:19|20)\d\d)\)"


def _trim(symbol: Column) -> Column:
    """Without trailing points and hyphens, and without closing brackets that nothing opened."""
    bare = F.regexp_replace(symbol, r"[.\-]+$", "")
    for _ in range(3):
        loose = bare.endswith(")") & (F.regexp_count(bare, F.lit(r"\)")) > F.regexp_count(bare, F.lit(r"\(")))
        bare = F.when(loose, F.regexp_replace(F.regexp_replace(bare, r"\)$", ""), r"[.\-]+$", "")).otherwise(bare)
    return bare


def references(text: Column) -> Column:
    """The distinct document symbols a text names, in order of code points; joint symbols count for each series."""
    symbols = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(0)), lambda x: F.split(x, JOINT)))
    symbols = F.filter(F.transform(symbols, _trim), lambda x: x.rlike("[0-9]") & F.contains(x, F.lit("/")))
    assembly = F.transform(F.regexp_extract_all(text, F.lit(ASSEMBLY), F.lit(1)), lambda x: F.concat(F.lit("A/RES/"), x))
    council = F.transform(
        F.regexp_extract_all(text, F.lit(COUNCIL), F.lit(0)), lambda x: F.concat(F.lit("S/RES/"), F.regexp_replace(x, COUNCIL, "$1($2)"))
    )
    return F.array_sort(F.array_distinct(F.concat(symbols, assembly, council)))


def symbol_key(symbol: Column) -> Column:
    """The path a symbol is filed under: lower case, an underscore for each point, blank, hyphen and bracket."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(symbol), r"\.+$", "")), r"[.\s()\-]", "_")


def doc_key(doc_id: Column) -> Column:
    """A document id without its year folder."""
    return F.regexp_replace(doc_id, "^[^/]*/", "")
