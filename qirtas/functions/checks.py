"""Rules a generated question has to pass, as column expressions, and tolerant parsing of model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Wordings that point at a passage the reader never saw.
CONTEXT_EN = (
    r"\b(?:this|the above|the present|the aforementioned|the said|above-mentioned|the mentioned|the referenced|the cited)\s+(?:passage|text|excerpt|document|report|resolution|letter|note|paragraph|section|chapter|annex|decision)\b",
    r"\b(?:in|from|according to)\s+the\s+(?:passage|text|excerpt)\b",
    r"\b(?:mentioned|referred to|cited)\s+above\b",
    r"\bpassage\s+[ab12]\b",
)
DOCUMENT_EN = r"\b(?:in|from|according to|mentioned in|referred to in)\s+the\s+(?:document|report)\b"
DESCRIBED_EN = r"(?!\s+(?:that|which|entitled|on|of|by|concerning|submitted|issued|dated|prepared|in which)\b)"
CONTEXT_AR = (
    "هذا التقرير", "هذه الوثيقة", "هذا القرار", "هذه الرسالة", "هذه المذكرة", "هذا النص", "هذا المقطع", "المقتطف", "التقرير الحالي", "المذكور أعلاه", "المذكورة أعلاه", "الوارد أعلاه", "الواردة أعلاه",
    "المشار إليه أعلاه", "المشار إليها أعلاه", "لقرار المذكور", "لمقرر المذكور", "لتقرير المذكور", "لوثيقة المذكورة", "لرسالة المذكورة", "لاجتماع المذكور",
)
DESCRIBED_AR = r"(?!\s+(?:التي|الذي|المتعلقه|المعنونه|الصادره|المقدمه|المؤرخه|بشان|عن|حول)(?![\p{L}\p{N}_]))"
DOCUMENT_AR = (
    "في (?:الوثيقه|النص|المقطع|المقتطف)" + DESCRIBED_AR,
    r"(?:وفقا|طبقا|حسب|بحسب) (?:لل|ل|ال)?(?:وثيقه|تقرير|نص)(?![\p{L}\p{N}_])" + DESCRIBED_AR,
    r"ذكر(?:ها|ه|ت)? النص(?![\p{L}\p{N}_])",
)
DOCUMENT_NUMBER = r"[a-z]+/[\p{L}\p{N}_.]*[0-9]|(?<![\p{L}\p{N}_])[0-9]{1,4}\s*/\s*[0-9]{1,4}(?![\p{L}\p{N}_])"


def refers_to_context(question: Column, normal: Column, lang: str) -> Column:
    """Whether a question points at its passage; `normal` is the question in its normal form."""
    if lang == "en":
        return question.rlike("(?i)" + "|".join((*CONTEXT_EN, DOCUMENT_EN + DESCRIBED_EN)))
    phrases = [" ".join(T.fold_arabic(p).split()) for p in CONTEXT_AR]
    return normal.rlike("|".join((*phrases, *DOCUMENT_AR)))


def names_document(normal: Column) -> Column:
    """Whether a question in its normal form names a document by symbol or number."""
    return normal.rlike(DOCUMENT_NUMBER)


def parse_object(text: Column, schema: str) -> Column:
    """The JSON object from the first to the last brace of a text; NULL where there is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema, {"mode": "PERMISSIVE"})


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))) == "true", F.lit(False))
