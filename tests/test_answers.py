import json
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qirtas.operators import answers, contexts, metrics, paired, questions

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def outcome(spark, pairs):
    df = spark.createDataFrame([("c", str(i), bool(a), bool(b)) for i, (a, b) in enumerate(pairs)], "config string, qid string, a boolean, b boolean")
    return paired.mcnemar(df, ["config"]).first()


def exact(m, n):
    return min(1.0, 2 * sum(math.comb(m + n, i) for i in range(min(m, n) + 1)) / 2 ** (m + n)) if m + n else 1.0


def test_mcnemar_by_hand(spark):
    r = outcome(spark, zip([1, 1, 1, 0, 1, 0], [0, 0, 0, 1, 1, 0], strict=True))
    assert (r.only_a, r.only_b) == (3, 1) and math.isclose(r.p, 10 / 16)
    assert outcome(spark, [(1, 1), (0, 0)]).p == 1.0
    assert outcome(spark, [(1, 0)] * 20).p < 1e-5


@SETTINGS
@given(st.integers(0, 900), st.integers(0, 900))
def test_mcnemar_is_exact_and_symmetric(spark, m, n):
    df = spark.createDataFrame([(m, n), (n, m)], "m bigint, n bigint").select(paired.mcnemar_p(F.col("m"), F.col("n")))
    p, q = (r[0] for r in df.collect())
    assert math.isclose(p, exact(m, n), rel_tol=1e-6, abs_tol=1e-12) and p == q


def test_bootstrap(spark):
    data = [("c", f"q{i:02d}", i / 10, i / 10 - 0.1) for i in range(12)]
    df = spark.createDataFrame(data, "config string, qid string, a double, b double")
    r = paired.bootstrap(df, ["config"], resamples=500).first()
    assert r.n == 12 and math.isclose(r.mean, 0.1) and r.high - r.low < 1e-9
    mixed = df.withColumn("b", F.col("b") * 0)
    assert paired.bootstrap(mixed, ["config"]).first() == paired.bootstrap(mixed.repartition(3), ["config"]).first()
    rng = np.random.default_rng(0)
    d = np.array([x[2] for x in data])
    means = np.concatenate([d[rng.integers(0, 12, (min(256, 1000 - i), 12))].mean(axis=1) for i in range(0, 1000, 256)])
    assert math.isclose(paired.bootstrap(mixed, ["config"], resamples=1000).first().low, np.quantile(means, 0.025))
    assert paired.bootstrap(df.limit(0), ["config"]).count() == 0
    with pytest.raises(Exception, match="lacks"):
        paired.bootstrap(df.withColumn("a", F.lit(None).cast("double")), ["config"]).collect()
    h = paired.hash_bootstrap(mixed, ["config"], resamples=100).first()
    assert h.low <= h["mean"] <= h.high and math.isclose(h["mean"], d.mean())


def test_paired_report_keeps_shared_questions(spark):
    scores = spark.createDataFrame([("c", "en", "q", 1.0), ("c", "ar", "q", 0.0), ("c", "en", "r", 1.0)], "config string, pair string, qid string, mrr double")
    assert [(r.qid, r.a, r.b) for r in paired.paired_report(scores, ["config"], "pair", "en", "ar", ["mrr"]).collect()] == [("q", 1.0, 0.0)]


ROWS = [("m", "q1", True, True, False, True), ("m", "q2", True, False, True, None), ("m", "q3", False, True, False, False), ("m", "q4", False, False, False, False)]


def test_attribution_by_hand(spark):
    df = spark.createDataFrame(ROWS, "model string, qid string, retrieved boolean, correct boolean, abstained boolean, supported boolean")
    t = answers.attribution(df, ["model"]).first()
    assert [t[c] for c in answers.CELLS] == [1, 1, 1, 1]
    assert (t.accuracy, t.abstention_rate, t.hallucination_rate, t.hallucination_judged_n) == (0.5, 0.25, round(2 / 3, 6), 3)
    assert (t.abstention_when_retrieved, t.abstention_when_missed) == (0.5, 0.0)
    t = answers.attribution(df.filter("not retrieved").withColumn("supported", F.lit(None).cast("boolean")), ["model"]).first()
    assert t.abstention_when_retrieved is None and t.hallucination_rate is None
    assert answers.attribution(df.limit(0), ["model"]).count() == 0


def test_costs_models_and_languages(spark):
    df = spark.createDataFrame([("m", "en", "oracle", "q", True), ("m", "en", "rag", "q", False), ("m", "en", "rag", "x", True), ("n", "en", "rag", "q", False), ("m", "ar", "rag", "q", None)], "model string, lang string, condition string, qid string, correct boolean")
    d = answers.decomposition(df, ["model", "lang"]).collect()
    assert [(r.model, r.n, r.retrieval_cost, r.generation_cost) for r in d] == [("m", 1, 1.0, 0.0)]
    p = answers.model_pairs(df.filter("condition = 'rag' and lang = 'en'"), ["lang"]).first()
    assert (p.model_a, p.model_b, p.n, p.agreement) == ("m", "n", 1, 1.0)
    both = answers.language_pairs(df.filter("condition = 'rag' and model = 'm'"), ["model"]).collect()
    assert [(r.qid, r.a, r.b) for r in both] == [("q", False, False)]
    assert spark.range(1).select(answers.predicted_accuracy(F.lit(0.5), F.lit(0.9), F.lit(0.1))).first()[0] == pytest.approx(0.5)


def test_scores_and_differences(spark):
    df = spark.createDataFrame([("en", "The 21,456 dollars", "21 456 dollars"), ("ar", "المنظمة", "منظمة"), ("en", None, "x"), ("en", "in 1995 he", "year 1995"), ("en", "5", "6"), ("en", "red", "blue")], "lang string, answer string, reference string")
    s = answers.score(df).collect()
    assert [r.exact_match for r in s] == [True, True, False, False, False, False] and s[2].token_f1 == 0.0 and s[1].token_f1 == 1.0
    kinds = [r.kind for r in answers.difference_kind(df).collect()]
    assert kinds == ["digit grouping alone", "digit grouping alone", "wording differs, no numbers", "same numbers, wording around them differs", "numbers differ", "wording differs, no numbers"]
    j = answers.judged(spark.createDataFrame([(True, True, ["x"], True), (True, None, [], True), (None, False, ["x"], True)], "correct boolean, abstained boolean, context_ids array<string>, supported boolean")).collect()
    assert [(r.correct, r.supported) for r in j] == [(False, None), (True, None), (False, True)]
    m = answers.match_against_judge(spark.createDataFrame([("m", True, True, False), ("m", False, True, False), ("m", True, None, False), ("m", True, True, True)], "model string, exact_match boolean, correct boolean, abstained boolean"), ["model"]).first()
    assert (m["both"], m.neither, m.judge_only, m.match_only, m.not_judged) == (1, 1, 1, 0, 1)


def test_costs(spark):
    calls = spark.createDataFrame([("rag", "k1", "x" * 7), ("rag", "k1", "x" * 7), ("rag", "k2", None), ("oracle", "k3", "y")], "condition string, key string, prompt string")
    cache = spark.createDataFrame([("k3",)], "key string")
    assert {(r.condition, r.calls, r.pending, r.tokens) for r in answers.cost_estimate(calls, cache, ["condition"]).collect()} == {("rag", 3, 2, 2), ("oracle", 1, 0, 0)}
    line = spark.createDataFrame([("s", i, 2 * i + 1) for i in range(5)], "s string, c int, t int")
    r = answers.tokens_per_character(line, ["s"], "c", "t").first()
    assert (r.slope, r.intercept, r.r2) == (2.0, 1.0, 1.0)


def test_answering(spark):
    prompts = spark.createDataFrame([("closed_book", "p", []), ("rag:x", "p", ["a"]), ("rag:x", None, ["a"])], "condition string, prompt string, passages array<string>")
    out = answers.answer_with(prompts, lambda ps: [" NOT_IN_CONTEXT "] * len(ps)).collect()
    assert [(r.answer, r.abstained) for r in out] == [("NOT_IN_CONTEXT", False), ("NOT_IN_CONTEXT", True), (None, False)]
    for bad in (("closed_book", "p", ["x"]), ("magic", "p", [])):
        with pytest.raises(Exception, match="no such answering"):
            answers.answer_with(spark.createDataFrame([bad], prompts.schema), lambda ps: ps).collect()


def asked(spark):
    return spark.createDataFrame([("q1", ["g"], [["g", "copy", None], None]), ("q2", ["g", "h"], None), ("q3", None, None)], "qid string, gold_chunks array<string>, relevant_groups array<array<string>>")


def test_oracle_contexts(spark):
    pool = spark.createDataFrame([(f"c{i:02d}",) for i in range(50)] + [("g",), ("copy",), ("g",)], "doc string")
    got = {r.qid: r.context_ids for r in contexts.oracle_context(asked(spark), pool, 5, "s").collect()}
    assert all(len(set(v)) == 5 for v in got.values()) and "g" in got["q1"] and "copy" not in got["q1"] and {"g", "h"} <= set(got["q2"])
    again = {r.qid: r.context_ids for r in contexts.oracle_context(asked(spark).repartition(3), pool.repartition(2), 5, "s").collect()}
    assert again == got and set(got["q1"]) != set(got["q3"])
    assert got != {r.qid: r.context_ids for r in contexts.oracle_context(asked(spark), pool, 5, "t").collect()}
    with pytest.raises(Exception, match="do not fit"):
        contexts.oracle_context(asked(spark), pool, 1, "s").collect()
    assert {len(r.context_ids) for r in contexts.oracle_context(asked(spark), pool.limit(0), 5, "s").collect()} == {0, 1, 2}
    assert {r.qid: len(r.context_ids) for r in contexts.oracle_context(asked(spark), pool.limit(2), 5, "s").collect()} == {"q1": 3, "q2": 4, "q3": 2}


def test_contexts_and_positions(spark):
    run = spark.createDataFrame([("q", "b", 2), ("q", "a", 1), ("q", "c", 3)], "qid string, doc string, rank int")
    c = contexts.rag_context(run, 2)
    assert c.first().context_ids == ["a", "b"]
    qrels = metrics.judgements(spark.createDataFrame([("q", [["b", "a"], ["c"]])], "qid string, relevant_groups array<array<string>>"))
    p = contexts.gold_positions(c, qrels)
    assert [(r.grp, r.position) for r in p.orderBy("grp").collect()] == [(0, 1), (1, None)] and not contexts.retrieved_all(p).first().retrieved
    assert contexts.closed_book(run.select("qid").distinct()).first().context_ids == []
    t = spark.createDataFrame([(["x", "y"], "q")], "p array<string>, q string")
    text = t.select(contexts.render("Ask $q: ${p} $$5", q=F.col("q"), p=contexts.format_passages(F.col("p")))).first()[0]
    assert text == "Ask q: Passage 1:\n<<<\nx\n>>>\n\nPassage 2:\n<<<\ny\n>>> $5"
    with pytest.raises(KeyError):
        contexts.render("$x")


PASSAGE = {"passage": "The Council approved 12,500 dollars for water.", "question": "How much did the Council approve for water?", "answer": "12,500", "evidence": "The Council approved 12,500 dollars for water.", "question_t": "كم أقر المجلس للمياه؟", "answer_t": "12 500", "span": "12 500", "passage_t": "أقر المجلس 12 500 دولار للمياه"}
SINGLE = [({}, "accepted"), ({"skip": "true"}, "generator_skipped"), ({"answer": " "}, "missing_fields"), ({"evidence": "something else entirely"}, "evidence_not_in_passage"), ({"answer": "13,000"}, "answer_not_in_passage"),
    ({"question": "What does this passage approve?"}, "context_reference"), ({"question_t": ""}, "translation_missing_fields"), ({"question_t": "ماذا ورد في هذا التقرير؟"}, "context_reference_translated"), ({"answerable": "false"}, "not_answerable_translated"),
    ({"span": "999"}, "verified_answer_not_in_passage"), ({"same": None}, "answer_not_equivalent"), ({"passage": "The Council approved water.", "evidence": "The Council approved water.", "answer": "water"}, "answer_not_a_thousands_number")]


def test_single_gates(spark):
    base = {**PASSAGE, "skip": None, "answerable": "true", "same": "true"}
    names = list(base)
    df = spark.createDataFrame([(i, *({**base, **change}[n] for n in names)) for i, (change, _) in enumerate(SINGLE)], "i int, " + ", ".join(f"{n} string" for n in names))
    df, t = questions.prepare(df, {n: "ar" if n.endswith("_t") or n == "span" else "en" for n in PASSAGE})
    status = questions.single_status(t, "en", "ar", F.col("skip"), F.col("answerable"), F.col("same"), number=True)
    out = df.select("i", status.alias("status")).orderBy("i")
    assert [r.status for r in out.collect()] == [want for _, want in SINGLE]
    assert {(r.status, r.n) for r in questions.funnel(out, []).filter("status = 'accepted'").collect()} == {("accepted", 1)}


def test_comparison_and_bridge_gates(spark):
    base = {"passage_1": "Mission A has 500 staff.", "passage_2": "Mission B has 300 staff.", "question": "Which has more staff, Mission A or Mission B?", "option_1": "Mission A", "option_2": "Mission B", "evidence_1": "Mission A has 500 staff.", "evidence_2": "Mission B has 300 staff.",
            "question_t": "أيهما أكبر، ألف أم باء؟", "option_1_t": "ألف", "option_2_t": "باء"}
    more = {"skip": None, "idx": 1, "one": None, "two": None, "choice": 1}
    cases = [({}, "accepted"), ({"option_2": "mission a"}, "options_not_distinct"), ({"question": "Which has more staff?"}, "options_not_in_question"), ({"one": 2}, "shortcut_1_alone"), ({"two": 1}, "shortcut_2_alone"), ({"choice": None}, "not_answerable_translated"), ({"choice": 2}, "verified_choice_mismatch"), ({"idx": 3}, "missing_fields")]
    names = [*base, *more]
    df = spark.createDataFrame([(i, *({**base, **more, **c}[n] for n in names)) for i, (c, _) in enumerate(cases)], "i int, " + ", ".join(f"{n} {'int' if n in ('idx', 'one', 'two', 'choice') else 'string'}" for n in names))
    df, t = questions.prepare(df, {n: "ar" if n.endswith("_t") else "en" for n in base})
    status = questions.comparison_status(t, "en", "ar", F.col("skip"), F.col("idx"), F.col("one"), F.col("two"), F.col("choice"))
    assert [r.s for r in df.select("i", status.alias("s")).orderBy("i").collect()] == [w for _, w in cases]

    base = {"passage_a": "As requested in A/9, a note was issued.", "passage_b": "The plant cost 500 dollars.", "question": "What did the plant in the requested note cost?", "answer": "500 dollars", "evidence_a": "As requested in A/9, a note was issued.", "evidence_b": "The plant cost 500 dollars.",
            "passage_b_t": "كلفت المحطة 500 دولار", "question_t": "كم كلفت المحطة؟", "answer_t": "500 دولار", "span": "500 دولار"}
    more = {"skip": None, "b": None, "a": None, "ok": "true", "same": "true"}
    cases = [({}, "accepted"), ({"question": "What did A/9 cost?"}, "document_number_in_question"), ({"question_t": "كم كلفت 47/33؟"}, "document_number_in_question_translated"), ({"b": "true"}, "shortcut_b_alone"), ({"a": "true"}, "shortcut_a_alone"), ({"span": "9"}, "verified_answer_not_in_passage_b"), ({"answer": "9"}, "answer_not_in_passage_b")]
    names = [*base, *more]
    df = spark.createDataFrame([(i, *({**base, **more, **c}[n] for n in names)) for i, (c, _) in enumerate(cases)], "i int, " + ", ".join(f"{n} string" for n in names))
    df, t = questions.prepare(df, {n: "ar" if n.endswith("_t") or n == "span" else "en" for n in base})
    status = questions.bridge_status(t, "en", "ar", F.col("skip"), F.col("b"), F.col("a"), F.col("ok"), F.col("same"))
    assert [r.s for r in df.select("i", status.alias("s")).orderBy("i").collect()] == [w for _, w in cases]


def test_option_order(spark):
    df = spark.createDataFrame([(str(i), 1) for i in range(40)], "q string, c int").withColumn("s", questions.swapped(F.col("q"), F.lit("p")))
    flags = [r.s for r in df.collect()]
    assert 8 < sum(flags) < 32
    assert all(r.u == (2 if r.s else 1) for r in df.withColumn("u", questions.unswap(F.col("c"), F.col("s"))).collect())
    assert spark.range(1).select(questions.unswap(F.lit("x"), F.lit(True))).first()[0] is None


def _tries(status):
    return lambda wave: wave.withColumn("status", status)


def test_build_in_waves(spark):
    candidates = questions.numbered(spark.range(100).withColumnRenamed("id", "c"), [F.col("c").desc()], 50)
    assert candidates.count() == 50 and candidates.filter("place = 0").first().c == 99
    status = F.when(F.col("c") % 3 != 0, "accepted").otherwise("missing_fields")
    b = questions.build(candidates, _tries(status), 5)
    assert b.accepted == {"en->ar": 2, "ar->en": 3} and b.ended == "complete"
    rows = b.attempts.orderBy("place").collect()
    assert [r.place for r in rows] == list(range(len(rows))) and [r.direction for r in rows[:4]] == ["en->ar", "ar->en", "en->ar", "ar->en"]
    assert sum(r.status == "accepted" for r in rows) == 5 and rows[-1].wave > 0


def test_build_never_passes_a_quota(spark):
    candidates = spark.range(60).select(F.col("id").cast("int").alias("place"))
    one_sided = F.when(F.col("direction") == "ar->en", "accepted").otherwise("not_answerable_translated")
    b = questions.build(candidates, _tries(one_sided), 8)
    assert b.accepted == {"en->ar": 0, "ar->en": 4} and b.ended == "no candidates left" and b.attempts.count() == 60


def test_build_ends(spark):
    candidates = spark.range(3).select(F.col("id").cast("int").alias("place"))
    assert questions.build(candidates, _tries(F.lit("accepted")), 5).ended == "no candidates left"
    out = questions.build(candidates, _tries(F.when(F.col("place") == 0, "accepted").otherwise("no_allowance")), 3)
    assert out.ended == "allowance used up" and out.accepted == {"en->ar": 1, "ar->en": 0} and out.attempts.count() == 1
    for rows, target in ((candidates.limit(0), 4), (candidates, 0)):
        empty = questions.build(rows, _tries(F.lit("accepted")), target)
        assert empty.attempts.count() == 0 and empty.accepted == {"en->ar": 0, "ar->en": 0}
    assert questions.build(candidates, _tries(F.lit("accepted")), 1).accepted == {"en->ar": 0, "ar->en": 1}


def test_prompts_version():
    assert questions.prompts_version({"a": "x"}) != questions.prompts_version({"a": "y"})


def test_replay_and_replacement(spark, rows):
    old = spark.createDataFrame([("a", "accepted"), ("b", "bad"), ("c", "bad")], "k string, status string")
    new = spark.createDataFrame([("a", "accepted"), ("b", "accepted"), ("d", "bad")], "k string, status string")
    assert rows(questions.transitions(old, new, ["k"])) == [("accepted", "accepted", 1), ("bad", "accepted", 1), ("bad", "none", 1), ("none", "bad", 1)]
    kinds = spark.createDataFrame([("single", 1), ("numeric", 2), (None, 3)], "kind string, i int")
    assert rows(questions.replace_kinds(kinds, kinds.filter("i = 2").withColumn("i", F.lit(9)), ["numeric"]), "i") == [(1,), (3,), (9,)]


def test_stored_question_checks(spark):
    q = lambda i, kind, q, a, gold: (f"q{i}", kind, "en->ar", (q, "س"), (a, "ج"), gold)
    asked = spark.createDataFrame([q(1, "single", "Who?", "the Council", ["c1"]), q(2, "single", "Who?", "nobody", ["c1"]), q(3, "single", "What does this report say?", "the Council", ["c1"]), q(4, "numeric", "How many?", "5", ["c1"]), q(5, "bridge", "What of A/9?", "x", ["c1"]), q(6, "single", "Who?", "the Council", ["gone"]), q(7, "single", "Who?", None, ["c1"])],
        "qid string, kind string, direction string, question struct<en: string, ar: string>, answer struct<en: string, ar: string>, gold_chunks array<string>")
    chunks = spark.createDataFrame([("c1", "It was the Council."), ("c1", "It was the Council.")], "chunk_id string, en string")
    got = [r.status for r in questions.question_checks(asked, chunks).orderBy("qid").collect()]
    assert got == ["accepted", "answer_not_in_passage", "context_reference_en", "not_a_grouped_number", "document_number_in_question", "gold_not_in_corpus", "missing_fields"]
    assert json.dumps(got)
