"""Appropriations in the paragraphs of financing resolutions, as column expressions.

A paragraph is cut once, at the verb, the amount and the period; a table of rules names the kind by what stands in the cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of the resolutions (words that begin a new sentence, names of missions, verb, amount, period and
# end of the main clause, and where a mission is named).
OPENERS = "The|Having|Recalling|Noting|Decides|Requests|Reaffirming|Taking|Expressing|Welcoming|Concerned|Bearing|Mindful|Emphasizing|Stressing|Aware|Acknowledging|Recognizing|Endorses|Approves|Authorizes"
NAME_WORD = rf"(?!(?:{OPENERS})\b)[A-Z][\p{{L}}\p{{N}}_'’\-]*"
MISSION = rf"{NAME_WORD}(?:\s+(?:{NAME_WORD}|of|the|in|for|and|on|d['’][A-Z]\w*))*"
VERB = r"\bto appropriate\b"
AMOUNT = r"\b(?:the|an) (?:total |additional |gross )?amount of (?:US\s?)?\$?\s?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?\s(?:million|billion))"
PERIOD = r"\bperiod from (\d{1,2} [A-Z][a-z]+ \d{4}) to (\d{1,2} [A-Z][a-z]+ \d{4})"
CLAUSE_END = r"\binclusive\b|\bincluding\b|;"
IN_PARAGRAPH = rf"Special Account for the ({MISSION})\s+(?:the|an) (?:total |additional |gross )?amount"
IN_DOCUMENT = rf"(?:[Ff]inancing of|Special Account for) the ({MISSION})"
LOOSE_END = r"(?:\s+(?:of|the|in|for|and|on))+$"
TITLE = r"(?i)\bfinancing of the\b"
AMOUNT_WORD = "مبلغ"
# Fixed values: (kind, the cut that tells it, what it holds there); the first that holds counts.
KINDS = (
    ("additional", "clause", r"\badditional\b"),
    ("reduction", "clause", "reduc"),
    ("support_account", "between", r"\bsupport account\b|\bLogistics Base\b"),
    ("partial", "later", r"(?s)\bin addition to\b.{0,300}?\balready appropriated\b"),
)
WHOLE = "appropriation"


def amount(text: Column) -> Column:
    """An amount in figures or in millions and billions, as a whole number."""
    text = F.trim(text)
    scale = F.when(text.endswith("million"), 1_000_000).when(text.endswith("billion"), 1_000_000_000).otherwise(1)
    value = F.try_to_number(F.regexp_replace(text, r",|\s.*$", ""), F.lit("999999999999999D999999")) * scale
    return F.when(scale == 1, F.floor(value)).otherwise(F.bround(value, 0)).cast("bigint")


def full_name(name: Column) -> Column:
    """A mission's name without a loose end; NULL unless it has three words."""
    bare = F.regexp_replace(name, LOOSE_END, "")
    return F.when(F.size(F.split(bare, r"\s+")) >= 3, bare)


def canonical_mission(name: Column) -> Column:
    name = F.lower(F.regexp_replace(name, r"(?i)\s*\(continued\)", ""))
    return F.trim(F.regexp_replace(F.translate(F.replace(name, F.lit("peace-keeping"), F.lit("peacekeeping")), "’", "'"), r"\s+", " "))


def cuts(paragraph: Column) -> dict[str, Column]:
    """What stands around the first verb, the first amount after it and the first period of the same clause; NULL where one is missing."""
    behind = lambda text, pattern: F.get(F.split(text, pattern, 2), F.lit(1))
    said = behind(paragraph, VERB)
    after = behind(said, AMOUNT)
    dated = F.get(F.split(after, CLAUSE_END, 2), F.lit(0))
    between = F.when(dated.rlike(PERIOD), F.get(F.split(dated, PERIOD, 2), F.lit(0)))
    before = F.get(F.split(said, AMOUNT, 2), F.lit(0))
    return {
        "amount": F.regexp_extract(said, AMOUNT, 1),
        "clause": F.concat(before, F.regexp_extract(said, AMOUNT, 0), between),
        "between": between,
        "from": F.regexp_extract(dated, PERIOD, 1),
        "to": F.regexp_extract(dated, PERIOD, 2),
        "later": behind(after, PERIOD),
        "up_to_amount": F.left(paragraph, F.length(paragraph) - F.length(after)),
    }


def appropriation(paragraph: Column) -> Column:
    """Struct of amount_text, amount, period, kind, mission of a paragraph that appropriates; NULL for others."""
    cut = cuts(paragraph)
    kind = F.coalesce(*(F.when(cut[where].rlike(pattern), F.lit(name)) for name, where, pattern in KINDS), F.lit(WHOLE))
    fields = {"amount_text": cut["amount"], "amount": amount(cut["amount"]), "period": F.concat_ws(" - ", cut["from"], cut["to"]), "kind": kind, "mission": full_name(F.regexp_extract(cut["up_to_amount"], IN_PARAGRAPH, 1))}
    return F.when(cut["between"].isNotNull(), F.struct(*(value.alias(name) for name, value in fields.items())))


def confirms(normal: Column, amount_text: Column) -> Column:
    """Whether a normalised Arabic paragraph about an amount has the amount, grouped or with its scale word."""
    plain = F.substring_index(amount_text, ".", 1)
    grouped = F.concat_ws("|", F.replace(plain, F.lit(","), F.lit(" ")), plain, F.replace(plain, F.lit(","), F.lit("")))
    word = F.when(amount_text.endswith("million"), "(?:مليون|ملايين)").otherwise("(?:بليون|مليار|بلايين)")
    scaled = F.concat(F.replace(F.split(amount_text, " ")[0], F.lit("."), F.lit("[.,٫]")), F.lit(r"\s*(?:من\s*)?"), word)
    pattern = F.concat(F.lit("(^|[^0-9])(?:"), F.when(amount_text.rlike("illion$"), scaled).otherwise(grouped), F.lit(")([^0-9]|$)"))
    return F.contains(normal, F.lit(AMOUNT_WORD)) & F.regexp_like(normal, pattern)


def document_missions(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, mission): the mission name of three words and more that a document has most often; of equals the longest."""
    names = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(IN_DOCUMENT), F.lit(1))).alias("n")).select(key, full_name(F.col("n")).alias("n"))
    counted = names.filter("n IS NOT NULL").groupBy(key, "n").agg(F.count("*").alias("times"))
    return counted.groupBy(key).agg(F.max_by("n", F.struct("times", F.length("n"), "n")).alias("mission"))
