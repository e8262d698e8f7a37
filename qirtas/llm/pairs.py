"""Broken prompt and response pairs (problem 1).

Copies of the prompt are found by compressing the response with the prompt as
zstandard dictionary and the prompt with the response as one: the bytes that
either side adds to the other decide.  Refusals and foreign answers are found by
dictionaries; answers that break off by a terminal-context model counted over
all pairs: how often a word ends a text or goes on, and which longer words stand
where it stands.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_arabic
from ..operators.lineage import drop_table, materialize, small_or_not, spread
from .canon import canonical

#: A copy takes at most so many bytes more, compressed with its prompt, than the prompt itself does; below, words decide ties.
COPY_BYTES = 8
#: A copy compresses its prompt to this share of what it takes without the copy, or less.
COPY_RATIO = 0.6
#: A prompt of which compression with itself saves fewer bytes is too short, or of too few different letters, for sizes to tell: its words decide.
LEAST_SAVED = 8
#: A word that ends fewer than this share of its places, of at least so many, does not end a text.
END_SHARE, LEAST_PLACES = 0.03, 20

# Words that frame a copied prompt without adding to it.
FRAME = frozenset("question questions q a answer answers you asked ask i was were asked: the is was: query سألت السؤال سؤال الجواب جواب اجابة الاجابة هو هي س ج".split())
# Whole answers that are tokens of declining.
DECLINE_TOKENS = frozenset(
    {"unknown", "not in context", "not in the context", "not in passage", "not in the passage", "not in the passages", "n a", "no answer", "not available", "not known", "unanswerable", "cannot answer", "no information", "غير معروف", "لا جواب", "لا يوجد جواب", "غير متاح", "غير وارد في السياق"}
)
# Phrases of declining, English and (with folded letters) Arabic.
DECLINE_EN = (
    r"not_in_context|\bnot in (the )?(context|passages?)\b",
    r"\b(i|we)( am|'m| are|'re)? (also |really |simply |just )?(cannot|can't|can not|unable to|not able to|not sure|could not|couldn't|don't know|do not know|do not have|don't have|would rather not|prefer not|won't|will not|must decline|decline|refuse|have no)\b",
    r"\bno answer (can|could) be (given|provided|found)\b",
    r"\b(not enough|insufficient|no( relevant)?) information\b",
    r"\b(this|that|the|such) (information|answer|detail)s? (is|are|was|were) (not|un)\s?(available|known|given|provided|mentioned|stated|included|contained|present)",
    r"\b(passages?|texts?|context|documents?|sources?)( that (was|were))?( provided| given| shown)? (do|does|did) not (say|mention|state|contain|include|provide|give|specify|answer|tell)\b",
    r"\bas an? (ai|assistant|language model)\b",
    r"\b(unable|not possible|impossible) to (answer|determine|say|tell|respond)\b",
    r"^(i'm|i am|we are|we're)? ?(very |so )?sorry\b",
    r"^(my )?apologies\b",
)
DECLINE_AR = (
    "لا استطيع|لا يمكنني|لا يمكن (الاجابه|تحديد|الرد)|يتعذر علي|تتعذر الاجابه|لا اعرف|لا اعلم|لا ادري|ليست? لدي|لا املك|افضل عدم|افضل الا",
    "لا (تذكر|تتضمن|تحتوي|تشير|يذكر|يتضمن|يحتوي|ترد|يرد) (النصوص|المقاطع|النص|المقطع|الوثائق|الوثيقه|السياق)",
    "(معلومات|المعلومات|المعلومه)( المتاحه| المقدمه)? (غير|ليست) (كافيه|متاحه|متوفره)|لا توجد معلومات|لا تتوفر|معلومات غير كافيه|لا يوجد ما يكفي|غير كافيه للاجابه",
    "^(عذرا|اعتذر|معذره|للاسف|اسف|ناسف)( |$)",
    "بصفتي (مساعدا|نموذجا)|لا يمكن اعطاء|لا يمكن تقديم|لا يسعني|تعذر",
)
# Function words by language.
FUNCTION_WORDS = {
    "en": "the of in to and because before for on is at by with from was were had been that this not no an a as answer according its",
    "fr": "le la les des du de et que qui parce était étaient par une un dans selon avant fin pour sur avec est au aux ce cette en ne pas plus",
    "es": "el la los las de del y que porque por para no había una un en con se su según antes está fue al lo como más",
    "de": "der die das und des vor nach ende im den dem ein eine für mit von zu nicht ist war wurde weil bei auf aus durch über",
    "it": "il lo la gli le di del della e che perché per non una un in con si è era prima dopo secondo",
    "pt": "o a os as de do da e que porque por para não uma um em com se foi antes depois segundo",
}
PERSIAN = frozenset("که است این از را برای می شد شده بود آن تا یا ها کرد ہے ہیں کے کی کا میں نے سے کو اور".split())
MONTHS = frozenset("january february march april may june july august september october november december يناير فبراير مارس ابريل مايو يونيه يوليه اغسطس سبتمبر اكتوبر نوفمبر ديسمبر".split())

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|_")
_SYMBOL = re.compile(r"\b[a-z]{1,6}(?:/[\w.()-]+)+")
_QUOTED = re.compile(r"\s*(?:\([^()]*\)|«[^«»]*»|\[[^\[\]]*\])")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"\d[\d,.  ]*\d|\d")
_BAD_GROUP = re.compile(r"(?<![\d,])\d{1,3}(?:,\d{3})*,\d{1,2}$")
_MARKS = dict.fromkeys([*range(0x64B, 0x660), 0x670, 0x640])
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
# Words of other languages that are too common in English to count.
_SHARED = frozenset("a in no an on was as is die war".split())
_OTHERS = {k: v - _SHARED for k, v in _SETS.items() if k != "en"}
_ANY_OTHER = frozenset().union(*_OTHERS.values())
_SHOWN = re.compile(r"[^\W_]")
_LEAD = re.compile(r"^(?:the )?(?:answer|الجواب|response)(?: is| هو)?\s*:?\s*")
_LATIN, _ARABIC, _LETTER = re.compile(r"[a-zÀ-ɏ]+"), re.compile(r"[ؠ-يٱ-ۓ]+"), re.compile(r"[^\W\d_]+")
_OPEN_END, _DAY = re.compile(r"\w$"), re.compile(r"([^\W\d_]+) (\d{1,3})$")
_PIECE = re.compile(r"#|@|[^\W\d_]+(?:['’-][^\W\d_]+)*")
_EN = re.compile("|".join(DECLINE_EN))
_AR = re.compile("|".join(DECLINE_AR))


def plain(text: str) -> str:
    """The form the checks read: consistent characters, no vowel marks, single blanks."""
    text = canonical(text)
    return " ".join((text if text.isascii() else text.translate(_MARKS).replace("’", "'")).split())


def _folded(text: str) -> str:
    return text if text.isascii() else fold_arabic(text)


# Each phrase of DECLINE_EN holds one of these.
_HINTS = ("not", "n't", "unable", "decline", "refuse", "no ", "insufficient", " un", "as a", "impossible", "sorry", "apolog")


def declines(text: str) -> bool:
    """Whether a text in its plain form declines to answer."""
    said = text.strip(" .!?؟\"'«»()[]:;…-")
    bare = said
    if "(" in bare or "«" in bare or "[" in bare:
        bare = _QUOTED.sub("", bare)
    if len(bare) < 80:
        bare = _LEAD.sub("", bare).strip(" .!?؟\"'«»:;…-")
        if len(bare) < 40 and " ".join(bare.replace("_", " ").replace("/", " ").split()) in DECLINE_TOKENS:
            return True
    if any(h in said for h in _HINTS) and _EN.search(said):
        return True
    return not said.isascii() and bool(_AR.search(fold_arabic(said)))


@functools.lru_cache(32)
def _compressor(known: bytes) -> zstandard.ZstdCompressor:
    """A compressor with what is known as its dictionary; the answers to a prompt mostly stand together."""
    book = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False)


def _compressed(text: bytes, known: bytes) -> int:
    """Bytes of a text compressed with what is known as its dictionary."""
    return len(_compressor(known).compress(text))


_FRAME = " ".join(sorted(FRAME)).encode() + b" | "


@functools.lru_cache(10_000)
def _prompt(prompt: str) -> tuple[frozenset[str], bytes, int]:
    """(words, their bytes, compressed with themselves) of a prompt in plain form; framing words left out."""
    words = [w for w in _WORD.findall(prompt) if w not in FRAME]
    raw = " ".join(words).encode("utf-8")
    return frozenset(words), raw, _compressed(raw, _FRAME + raw)


def copies(text: str, prompt: str, words: list[str] | None = None) -> bool:
    """Whether a text gives back its prompt and nothing else of content (both in plain form).

    The text adds nothing if, compressed with the prompt as dictionary, it takes no more than the prompt itself; it is
    a copy if it also compresses the prompt well.  Of the few bytes a text may add, those of words that the prompt
    lacks are content, unless they compress to less than half (a prompt's word misspelt).
    """
    asked, raw, own = _prompt(prompt)
    words = [w for w in (_WORD.findall(text) if words is None else words) if w not in FRAME]
    if not asked or not words:
        return False
    said = " ".join(words).encode("utf-8")
    added = _compressed(said, _FRAME + raw) - own
    same = set(words) == asked
    if added > COPY_BYTES and not same:
        return False
    alone = _compressed(raw, _FRAME)
    if alone - own < LEAST_SAVED:
        return same
    if added > COPY_BYTES or _compressed(raw, _FRAME + said) > COPY_RATIO * alone:
        return False
    new = sum(len(w.encode("utf-8")) for w in words if w not in asked)
    return new == 0 or 2 * added < new


def foreign(text: str, raw: str, lang: str, words: list[str] | None = None) -> bool:
    """Whether a text in plain form is written in another language than `lang`; what it quotes in brackets is passed over."""
    if lang not in ("en", "ar"):
        return False
    if lang == "en" and text.isascii() and _ANY_OTHER.isdisjoint(_WORD.findall(text) if words is None else words):
        return False
    body = _QUOTED.sub(" ", text)
    body = _SYMBOL.sub(" ", body if _SHOWN.search(body) else text)
    latin, arabic, letters = (sum(map(len, x.findall(body))) for x in (_LATIN, _ARABIC, _LETTER))
    if not letters:
        return False
    if lang == "ar":
        return arabic * 2 < letters or (not PERSIAN.isdisjoint(raw.split()) and sum(w in PERSIAN for w in raw.split()) >= 2)
    if latin * 2 < letters:
        return True
    words = _WORD.findall(body)
    if sum(w in _ANY_OTHER for w in words) < 2:
        return False
    own = sum(w in _SETS["en"] for w in words)
    other = max(sum(w in s for w in words) for s in _OTHERS.values())
    return other >= 2 and other > own


def pieces(text: str) -> list[str]:
    """Words of a plain text for the terminal-context model; numbers and symbols are one word each."""
    if "/" in text:
        text = _SYMBOL.sub("@", text)
    if _DIGIT.search(text):
        text = _NUMBER.sub("#", text)
    return _PIECE.findall(_folded(text))


_plain_prompt = functools.lru_cache(10_000)(plain)


@functools.lru_cache(100_000)
def look(response: str | None, prompt: str | None, lang: str | None, abstained: bool) -> tuple[str | None, str | None, str | None, list[str]]:
    """(defect or None, the word before the last, the last word, all words) of one pair.

    The defects told apart here are empty, refusal, copied_question, other_language, and truncated where the text
    itself shows it; "" means that the pair is no case whatever its end.  The last word is None where the text is closed.
    """
    if response is None or not _SHOWN.search(response):
        return "empty", None, None, []
    text = plain(response)
    if not _SHOWN.search(text):
        return "empty", None, None, []
    if declines(text):
        return ("" if abstained else "refusal"), None, None, []
    found = _WORD.findall(text)
    if prompt is not None and copies(text, _plain_prompt(prompt), found):
        return "copied_question", None, None, []
    if foreign(text, response, lang or "", found):
        return "other_language", None, None, []
    body = text.rstrip("\"' ")
    words = pieces(body)
    if words and body.endswith(("..", "…")):
        return "truncated", None, None, []
    if not _OPEN_END.search(body[-1:]):
        return None, None, None, words
    if body[-1].isdigit():
        if _BAD_GROUP.search(body):
            return "truncated", None, None, []
        short = _DAY.search(_folded(body))
        if short and short[1] in MONTHS:
            return "truncated", None, None, []
    if not words:
        return None, None, None, []
    return None, words[-2] if len(words) > 1 else "", words[-1], words


def inspect(pairs: DataFrame) -> DataFrame:
    """`pairs` (tbl, record_id, lang, prompt, response, abstained) with label, before, last, words of `look`."""
    narrow = spread(pairs.select("tbl", "record_id", "lang", F.col("prompt").cast("string").alias("prompt"), F.col("response").cast("string").alias("response"), F.coalesce("abstained", F.lit(False)).alias("abstained")))

    def run(batches):
        for batch in batches:
            out = [look(r, p, x, a) for r, p, x, a in zip(*(batch.column(k).to_pylist() for k in (4, 3, 2, 5)), strict=True)]
            label, before, last, words = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(x, pa.string()) for x in (label, before, last)), pa.array(words, pa.list_(pa.string()))],
                ["tbl", "record_id", "lang", "label", "before", "last", "words"],
            )

    return narrow.mapInArrow(run, "tbl string, record_id string, lang string, label string, before string, last string, words array<string>")


def prompt_words(prompts: DataFrame) -> DataFrame:
    """(lang, words) of prompts (lang, prompt)."""

    def run(batches):
        for batch in batches:
            words = [pieces(plain(x)) if x else [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["lang", "words"])

    return prompts.select("lang", F.col("prompt").cast("string")).mapInArrow(run, "lang string, words array<string>")


def broken_ends(seen: DataFrame, prompts: DataFrame) -> DataFrame:
    """(lang, before, last) of the endings that break off, by the counts of all texts.

    Prompts count as texts too, as their ends are sound.  A word breaks off if it hardly ever ends a text though it is common, or if a longer word that begins with it is
    far more common after the same word, or if it is known from no other place and such a longer word is.

    Longer words are met by a hash of their beginnings, and only of as many letters as some ending has.
    """
    texts = seen.filter("label IS NULL").select("lang", "words").unionByName(prompt_words(prompts))
    place = lambda w, i: F.struct(w.alias("w"), F.when(i > 0, F.get("words", i - 1)).otherwise("").alias("p"), (i == F.size("words") - 1).alias("last"))
    places = texts.select("lang", F.explode(F.transform("words", place)).alias("x")).select("lang", "x.w", "x.p", "x.last")
    two = materialize(places.groupBy("lang", "p", "w").agg(F.count("*").alias("n"), F.count_if(F.col("last")).alias("n_end")))
    one = materialize(two.groupBy("lang", "w").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end")))
    ends = materialize(seen.filter("label IS NULL AND last IS NOT NULL AND last NOT IN ('#', '@')").select("lang", F.col("before").alias("p"), F.col("last").alias("w")).distinct())
    lengths = materialize(ends.groupBy("lang").agg(F.collect_set(F.length("w")).alias("lengths")))

    def longer(counted: DataFrame, by: list[str]) -> DataFrame:
        """(by, start, longer): how common the most common word is that goes on from the beginning hashed to `start`; of endings alone."""
        shorter = counted.join(small_or_not(lengths), "lang").select(*by, "w", "n", F.explode(F.filter("lengths", lambda k: k < F.length("w"))).alias("k"))
        begun = shorter.select(*by, F.xxhash64(F.substring(F.col("w"), F.lit(1), F.col("k"))).alias("start"), "n")
        wanted = materialize(ends.select(*by, F.xxhash64("w").alias("start")).distinct())
        return begun.join(small_or_not(wanted), [*by, "start"], "left_semi").groupBy(*by, "start").agg(F.max("n").alias("longer"))

    known = ends.join(one, ["lang", "w"]).join(two.select("lang", "p", "w", F.col("n").alias("n2")), ["lang", "p", "w"]).withColumn("start", F.xxhash64("w"))
    known = known.join(longer(one, ["lang"]).withColumnRenamed("longer", "longer1"), ["lang", "start"], "left")
    known = known.join(longer(two, ["lang", "p"]).withColumnRenamed("longer", "longer2"), ["lang", "p", "start"], "left").na.fill(0, ["longer1", "longer2"])
    never = (F.col("n") - F.col("n_end") >= LEAST_PLACES) & (F.col("n_end") < END_SHARE * F.col("n"))
    part = (F.col("longer2") >= 3) & (F.col("longer2") >= 4 * F.col("n2"))
    new = (F.col("n") == F.col("n_end")) & (F.col("longer1") >= 3) & (F.col("longer1") >= 10 * F.col("n_end"))
    broken = materialize(known.filter(never | part | new).select("lang", F.col("p").alias("before"), F.col("w").alias("last")))
    drop_table(two, one, ends, lengths)
    return broken


def defects(pairs: DataFrame, prompts: DataFrame) -> DataFrame:
    """(tbl, record_id, lang, defect) of the pairs (tbl, record_id, lang, prompt, response, abstained) that have one.

    The first that holds of empty, refusal, copied_question, other_language, truncated.  A NULL response is empty; a
    pair without prompt is no copy; NULL abstained is false; a language other than en and ar is never foreign.
    Repeated rows count once.  `prompts` (lang, prompt) are all texts prompts are made of, the lexicon's source.
    """
    seen = materialize(inspect(pairs))
    broken = broken_ends(seen, prompts.distinct())
    ends = seen.filter("label IS NULL AND last IS NOT NULL").join(small_or_not(broken), ["lang", "before", "last"], "left_semi")
    told = seen.filter("label <> ''").select("tbl", "record_id", "lang", F.col("label").alias("defect"))
    return told.unionByName(ends.select("tbl", "record_id", "lang", F.lit("truncated").alias("defect"))).distinct()


def question_pairs(generation: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, prompts) of the two tables: generated answers with their questions, and the reference answers."""
    asked = questions.select("qid", "question", "answer").distinct()
    one = asked.groupBy("qid").agg(F.max(F.struct("question.en", "question.ar")).alias("question"))
    prompt = F.when(F.col("lang") == "ar", F.col("question.ar")).otherwise(F.col("question.en"))
    made = generation.select("gen_id", "qid", "lang", "answer", "abstained").distinct().join(one, "qid", "left").select(
        F.lit("generation").alias("tbl"), F.col("gen_id").cast("string").alias("record_id"), "lang", prompt.alias("prompt"), F.col("answer").alias("response"), "abstained"
    )
    given = [
        asked.select(F.lit("questions").alias("tbl"), F.col("qid").alias("record_id"), F.lit(x).alias("lang"), F.col(f"question.{x}").alias("prompt"), F.col(f"answer.{x}").alias("response"), F.lit(False).alias("abstained"))
        for x in ("en", "ar")
    ]
    prompts = asked.select(F.lit("en").alias("lang"), F.col("question.en").alias("prompt")).unionByName(asked.select(F.lit("ar").alias("lang"), F.col("question.ar").alias("prompt")))
    return made.unionByName(given[0]).unionByName(given[1]), prompts
