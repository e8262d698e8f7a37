"""Scoring answers, and telling retrieval errors from generation errors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import text as T

CELLS = ("retrieved_correct", "retrieved_wrong", "missed_correct", "missed_wrong")
# Signs that may group digits.
GROUPING = "(?<=[0-9])[,\\s\\u00a0\\u202f\\u066c](?=[0-9])"


def exact_match(a: Column, b: Column) -> Column:
    """Of two arrays of answer tokens: equal and not empty."""
    return (F.size(a) > 0) & (F.array_join(a, "\x00") == F.array_join(b, "\x00"))


def score(rows: DataFrame, answer: str = "answer", reference: str = "reference") -> DataFrame:
    """Rows (lang, answer, reference) with exact_match and token_f1; NULL texts have no tokens; other languages are scored as English."""
    ar = F.col("lang") == "ar"

    def toks(c: str) -> Column:
        nfkc = F.col(f"_{c}")
        return F.when(ar, T.content_tokens(T.words(T.fold(nfkc, "ar")), "ar")).otherwise(T.content_tokens(T.words(T.fold(nfkc, "en")), "en"))

    out = rows.withColumns({f"_{c}": T.unicode_form(F.coalesce(F.col(c), F.lit(""))) for c in (answer, reference)})
    out = out.withColumns({"_x": toks(answer), "_y": toks(reference)})
    return out.withColumns({"exact_match": exact_match(F.col("_x"), F.col("_y")), "token_f1": T.token_f1(F.col("_x"), F.col("_y"))}).drop("_x", "_y", f"_{answer}", f"_{reference}")


def judged(rows: DataFrame) -> DataFrame:
    """Rows with a judge's verdict made sound: an abstention is never correct; support is known only of answers with context."""
    off = F.coalesce("abstained", F.lit(False))
    has_context = F.coalesce(F.size("context_ids"), F.lit(0)) > 0
    return rows.withColumns({"correct": F.coalesce("correct", F.lit(False)) & ~off, "supported": F.when(~off & has_context, F.col("supported"))})


def cell(retrieved: Column, correct: Column) -> Column:
    return F.concat(F.when(retrieved, "retrieved").otherwise("missed"), F.when(correct, "_correct").otherwise("_wrong"))


def _rate(hit: Column, among: Column) -> Column:
    return F.round(F.try_divide(F.count_if(hit & among), F.count_if(among)), 6)


def attribution(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates per `by` of rows (retrieved, correct, abstained, supported).

    NULL in the first three counts as false.  The hallucination rate is over judged answers that do not abstain; rates
    over nothing are NULL.
    """
    r, c, a = (F.coalesce(F.col(x), F.lit(False)) for x in ("retrieved", "correct", "abstained"))
    told = ~a & F.col("supported").isNotNull()
    here = cell(r, c)
    always = F.lit(True)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), *(F.count_if(here == x).alias(x) for x in CELLS), _rate(c, always).alias("accuracy"), _rate(r, always).alias("retrieval_rate"), _rate(a, always).alias("abstention_rate"),
        _rate(a, r).alias("abstention_when_retrieved"), _rate(a, ~r).alias("abstention_when_missed"), _rate(~F.coalesce("supported", F.lit(True)), told).alias("hallucination_rate"), F.count_if(told).alias("hallucination_judged_n"),
    )


def decomposition(rows: DataFrame, by: list[str], oracle: str = "oracle") -> DataFrame:
    """Retrieval and generation cost per `by` and condition, on the questions both it and `oracle` answered.

    rows (qid, condition, correct): of several answers to a question the mean counts.
    """
    each = rows.groupBy(*by, "condition", "qid").agg(F.avg(F.coalesce("correct", F.lit(False)).cast("double")).alias("c"))
    best = each.filter(F.col("condition") == oracle).select(*by, "qid", F.col("c").alias("o"))
    shared = each.filter(F.col("condition") != oracle).join(best, [*by, "qid"])
    return shared.groupBy(*by, "condition").agg(F.count("*").alias("n"), F.round(F.avg("o") - F.avg("c"), 6).alias("retrieval_cost"), F.round(1 - F.avg("o"), 6).alias("generation_cost"))


def model_pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """Every pair of models per `by`: shared questions, both accuracies, their difference and how often they agree.

    rows (model, qid, correct): a question counts as correct for a model if any of its answers is.
    """
    each = rows.groupBy(*by, "model", "qid").agg(F.bool_or(F.coalesce("correct", F.lit(False))).alias("c"))
    a, b = each.withColumnsRenamed({"model": "model_a", "c": "a"}), each.withColumnsRenamed({"model": "model_b", "c": "b"})
    both = a.join(b, [*by, "qid"]).filter("model_a < model_b")
    x, y = F.col("a").cast("double"), F.col("b").cast("double")
    return both.groupBy(*by, "model_a", "model_b").agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("acc_a"), F.round(F.avg(y), 6).alias("acc_b"), F.round(F.avg(x - y), 6).alias("difference"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("agreement"))


def language_pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, qid, a, b): whether a question was answered correctly in English and in Arabic, where both were tried."""
    each = rows.groupBy(*by, "qid").pivot("lang", ["en", "ar"]).agg(F.bool_or(F.coalesce("correct", F.lit(False))))
    return each.filter("en IS NOT NULL AND ar IS NOT NULL").withColumnsRenamed({"en": "a", "ar": "b"})


def predicted_accuracy(recall: Column, oracle: Column, closed: Column) -> Column:
    return recall * oracle + (1 - recall) * closed


def difference_kind(rows: DataFrame, answer: str = "answer", reference: str = "reference") -> DataFrame:
    """Rows (lang, answer, reference) with kind: what an exact match would have needed."""
    out = rows.withColumns({f"{c}_": F.regexp_replace(F.coalesce(F.col(c), F.lit("")), GROUPING, "") for c in (answer, reference)})
    out = score(out, f"{answer}_", f"{reference}_").withColumnRenamed("exact_match", "_same").drop("token_f1")
    found = [F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(f"{c}_"), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))) for c in (answer, reference)]
    x, y = F.size(found[0]) > 0, F.size(found[1]) > 0
    kind = (
        F.when(F.col("_same"), "digit grouping alone").when(x & (F.array_join(found[0], " ") == F.array_join(found[1], " ")), "same numbers, wording around them differs")
        .when(x & y, "numbers differ").otherwise("wording differs, no numbers")
    )
    return out.withColumn("kind", kind).drop("_same", f"{answer}_", f"{reference}_")


def match_against_judge(rows: DataFrame, by: list[str]) -> DataFrame:
    """2 x 2 counts of exact match and verdict (exact_match, correct, abstained); rows without a verdict are counted apart."""
    off = F.coalesce("abstained", F.lit(False))
    told = F.col("correct").isNotNull()
    e, c = F.coalesce("exact_match", F.lit(False)) & ~off, F.coalesce("correct", F.lit(False)) & ~off
    return rows.groupBy(*by).agg(
        F.count_if(told & e & c).alias("both"), F.count_if(told & ~e & ~c).alias("neither"), F.count_if(told & c & ~e).alias("judge_only"), F.count_if(told & e & ~c).alias("match_only"), F.count_if(~told).alias("not_judged")
    )


def tokens_per_character(rows: DataFrame, by: list[str], chars: str, tokens: str) -> DataFrame:
    """Least squares of tokens on characters: slope, intercept, R squared."""
    y, x = F.col(tokens).cast("double"), F.col(chars).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


def approximate_tokens(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 3.5)


def cost_estimate(calls: DataFrame, cache: DataFrame, by: list[str]) -> DataFrame:
    """Calls, those not in the cache (each distinct key once), and their estimated prompt tokens; calls (key, prompt), cache (key)."""
    left = calls.join(cache.select("key").distinct(), "key", "left_anti").select(*by, "key", approximate_tokens(F.col("prompt")).alias("t"))
    pending = left.dropDuplicates(["key"]).groupBy(*by).agg(F.count("*").alias("pending"), F.sum("t").alias("tokens"))
    return calls.groupBy(*by).agg(F.count("*").alias("calls")).join(pending, by, "left").na.fill(0, ["pending", "tokens"])


def answer_with(prompts: DataFrame, answerer: Callable[[list[str]], list[str]], prompt: str = "prompt") -> DataFrame:
    """`prompts` (condition, prompt, passages) with answer and abstained; each distinct prompt of a batch is asked once.

    A closed-book prompt with passages fails, as does an unknown condition.
    """
    known = F.substring_index("condition", ":", 1).isin("closed_book", "oracle", "rag")
    bad = ~known | ((F.col("condition") == "closed_book") & (F.coalesce(F.size("passages"), F.lit(0)) > 0))
    checked = prompts.withColumn(prompt, F.when(bad, F.raise_error(F.concat(F.lit("no such answering: "), "condition"))).otherwise(F.col(prompt)))

    @F.pandas_udf("string")
    def ask(values: pd.Series) -> pd.Series:
        distinct = values.dropna().unique().tolist()
        known = dict(zip(distinct, answerer(distinct), strict=True))
        return pd.Series([known.get(v) for v in values], dtype=object)

    return checked.withColumn("answer", F.trim(ask(F.col(prompt)))).withColumn("abstained", T.abstains(F.col("answer"), F.col("condition")))


def within_allowance(prompts: DataFrame, cache: DataFrame, most: int, seed: str = "0") -> DataFrame:
    """The prompts (key, ...) a run may answer with `most` new calls: cached ones are free, of the others the first keys by hash.

    Rows that share a key cost one call.  A NULL key is never answered.
    """
    new = prompts.select("key").filter("key IS NOT NULL").distinct().join(cache.select("key").distinct(), "key", "left_anti")
    chosen = new.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), "key"), 256), "key").limit(most)
    allowed = chosen.unionByName(cache.select("key").distinct())
    return prompts.join(allowed.distinct(), "key", "left_semi").select(*prompts.columns)


def judge_with(rows: DataFrame, judge: Callable[[list[str]], list[str]], correctness: str = "correctness_prompt", support: str = "support_prompt") -> DataFrame:
    """`rows` (abstained, context_ids and two prompts) with correct and supported from a judge's JSON verdicts.

    The judge says {"correct": ...} and {"supported": ...}; anything else is no.  An abstention is wrong and is not
    shown to the judge; support is asked only of answers with context.  Each distinct prompt of a batch is asked once.
    """
    off = F.coalesce("abstained", F.lit(False))
    has_context = F.coalesce(F.size("context_ids"), F.lit(0)) > 0

    @F.pandas_udf("string")
    def ask(values: pd.Series) -> pd.Series:
        distinct = values.dropna().unique().tolist()
        known = dict(zip(distinct, judge(distinct), strict=True)) if distinct else {}
        return pd.Series([known.get(v) for v in values], dtype=object)

    asked = rows.withColumns({"_c": F.when(~off, F.col(correctness)), "_s": F.when(~off & has_context, F.col(support))})
    told = asked.withColumns({"_cv": ask(F.col("_c")), "_sv": ask(F.col("_s"))})
    correct = checks.truthy(checks.parse_object(F.col("_cv"), "correct string")["correct"])
    supported = F.when(F.col("_s").isNotNull(), checks.truthy(checks.parse_object(F.col("_sv"), "supported string")["supported"]))
    return told.withColumns({"correct": correct & ~off, "supported": supported}).drop("_c", "_s", "_cv", "_sv")
