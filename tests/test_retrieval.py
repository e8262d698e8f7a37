import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qirtas.functions import stemming
from qirtas.functions import text as T
from qirtas.operators import dense, fusion, metrics, retrieval, similarity
from qirtas.plans import grammar

DOCS = [("d0", ["council", "decided", "council"]), ("d1", ["assembly", "decided"]), ("d2", ["mission", "extended", "mandate", "council"])]
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def weight(tf, dl, df, n=3, avgdl=3.0):
    return tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) * math.log1p((n - df + 0.5) / (df + 0.5))


def test_bm25_by_hand(spark):
    docs = frame(spark, DOCS, "doc string, tokens array<string>")
    asked = frame(spark, [("q1", ["council", "council"]), ("q2", ["decided"]), ("q3", ["unknown"]), ("q4", [])], "qid string, tokens array<string>")
    got = {(r.qid, r.doc): (r.rank, r.score) for r in retrieval.bm25(docs, asked, 10).collect()}
    assert set(got) == {("q1", "d0"), ("q1", "d2"), ("q2", "d0"), ("q2", "d1")}
    assert math.isclose(got["q1", "d0"][1], weight(2, 3, 2)) and math.isclose(got["q1", "d2"][1], weight(1, 4, 2))
    assert got["q2", "d1"][0] == 1 and got["q2", "d0"][0] == 2


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_search_equals_all_scores(spark, block):
    rng = np.random.default_rng(1)
    docs = frame(spark, [(f"d{i:02d}", list(map(str, rng.integers(0, 12, rng.integers(0, 9))))) for i in range(60)] + [("e", None)], "doc string, tokens array<string>").repartition(3)
    asked = frame(spark, [(f"q{i}", list(map(str, rng.integers(0, 15, 3)))) for i in range(7)] + [("none", ["zz"]), ("null", None)], "qid string, tokens array<string>")
    whole = retrieval.top_k(retrieval.bm25_scores(docs.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))), asked), 5)
    fast = retrieval.bm25(docs, asked, 5, block=block)
    tidy = lambda df: sorted((r.qid, r["rank"], r.doc, round(r.score, 9)) for r in df.collect())
    assert tidy(fast) == tidy(whole)


def test_bm25_of_empty_tables(spark):
    docs = frame(spark, DOCS, "doc string, tokens array<string>")
    none = frame(spark, [], "qid string, tokens array<string>")
    assert retrieval.bm25(docs, none, 5).count() == 0
    assert retrieval.bm25(frame(spark, [], "doc string, tokens array<string>"), frame(spark, [("q", ["x"])], "qid string, tokens array<string>"), 5).count() == 0


def test_empty_documents_count_for_the_mean_length(spark):
    docs = frame(spark, [("a", ["x"]), ("b", [])], "doc string, tokens array<string>")
    score = retrieval.bm25_scores(docs, frame(spark, [("q", ["x"])], "qid string, tokens array<string>")).first().score
    assert math.isclose(score, weight(1, 1, 1, 2, 0.5))


def test_ties_go_to_the_smaller_item(spark):
    scores = frame(spark, [("q", "a", 0.5), ("q", "b", 0.9), ("q", "c", 0.5), ("q", "d", 0.9)], "qid string, doc string, score double")
    assert [(r.doc, r.rank) for r in retrieval.top_k(scores, 3).orderBy("rank").collect()] == [("b", 1), ("d", 2), ("a", 3)]


def test_analyzers(spark):
    texts = frame(spark, [("The Resolutions recommended", "والمنظمة قررت"), (None, None)], "en string, ar string")
    tokens = lambda lang, a: retrieval.analyze(texts, a, lang, text=lang).select("tokens").collect()
    assert [r.tokens for r in tokens("en", "light")] == [["the", "resolut", "recommend"], []]
    assert tokens("ar", "raw")[0].tokens == ["والمنظمة", "قررت"] and tokens("ar", "norm")[0].tokens == ["والمنظمه", "قررت"] and tokens("ar", "light")[0].tokens == ["منظم", "قررت"]
    with pytest.raises(ValueError):
        retrieval.analyze(texts, "strong", "en")
    with pytest.raises(ValueError):
        retrieval.analyze(texts, "raw", "fr")


def test_dense_by_hand(spark):
    vectors = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8]), (3, None)], "doc bigint, vector array<float>")
    asked = frame(spark, [(0, [0.0, 1.0]), (1, [1.0, 0.0])], "qid bigint, vector array<float>")
    got = dense.exact_search(vectors, asked, 2).orderBy("qid", "rank").collect()
    assert [(r.qid, r.doc, round(r.score, 6)) for r in got] == [(0, 1, 1.0), (0, 2, 0.8), (1, 0, 1.0), (1, 2, 0.6)]
    assert dense.exact_search(vectors, asked, 9, block_numbers=2).count() == 6
    assert dense.exact_search(vectors, asked.limit(0), 2).count() == 0
    assert dense.exact_search(vectors.limit(0), asked, 2).count() == 0


@SETTINGS
@given(st.integers(0, 10_000))
def test_dense_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-2, 3, (40, 3)).astype(float), rng.integers(-2, 3, (3, 3)).astype(float)
    vectors = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "doc bigint, vector array<double>").repartition(3)
    got = {(r.qid, r.rank): r.doc for r in dense.exact_search(vectors, frame(spark, [(i, v.tolist()) for i, v in enumerate(q)], "qid bigint, vector array<double>"), 7).collect()}
    want = {(i, k + 1): d for i in range(3) for k, d in enumerate(sorted(range(40), key=lambda d, i=i: (-(x[d] @ q[i]), d))[:7])}
    assert got == want


def test_encoding_asks_once_for_each_text(spark):
    texts = frame(spark, [(1, "a"), (2, "a"), (3, None), (4, "")], "id int, text string")
    got = {r.id: r.vector for r in dense.encode(texts, lambda ts: [[3.0, 4.0] if "a" in t else [0.0, 0.0] for t in ts], prefix="q:").collect()}
    assert [round(v, 6) for v in got[1]] == [0.6, 0.8] and got[2] == got[1] and got[3] is None and got[4] == [0.0, 0.0]
    keyed = frame(spark, [(1, "a"), (2, "b")], "o int, text string")
    assert dense.fingerprint(keyed, "o").first() != dense.fingerprint(keyed, "o", prefix="x").first()
    assert len(dense.fingerprint(keyed.repartition(3), "o").first().key) == 16 and dense.fingerprint(keyed, "o").first() == dense.fingerprint(keyed.repartition(3), "o").first()


def test_rrf_by_hand(spark):
    runs = [frame(spark, [("q", d, i + 1) for i, d in enumerate(x)], "qid string, doc string, rank int") for x in ("abc", "bd")]
    got = fusion.rrf(runs, 10).orderBy("rank").collect()
    assert [r.doc for r in got] == ["b", "a", "d", "c"] and math.isclose(got[0].score, 1 / 62 + 1 / 61)
    assert [r.doc for r in fusion.rrf(runs, 10, depth=2).orderBy("rank").collect()] == ["b", "a", "d"]
    swapped = fusion.rrf(runs[::-1], 10).orderBy("rank").collect()
    assert [(r.doc, round(r.score, 12)) for r in swapped] == [(r.doc, round(r.score, 12)) for r in got]


def test_rerank_scores_the_shortlist_only(spark):
    run = frame(spark, [("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "qid string, doc string, rank int")
    out = fusion.rerank(run, frame(spark, [("q", "x y")], "qid string, query string"), frame(spark, [("a", "z"), ("b", "x y"), ("c", "x y")], "doc string, text string"), lambda q, t: (q == t).cast("double"), 5, shortlist=2)
    assert [(r.doc, r.score) for r in out.orderBy("rank").collect()] == [("b", 1.0), ("a", 0.0)]


def measured(spark, ranking, groups):
    run = frame(spark, [("q", d, i + 1) for i, d in enumerate(ranking)], "qid string, doc string, rank int")
    qrels = metrics.judgements(frame(spark, [("q", groups)], "qid string, relevant_groups array<array<string>>"))
    return metrics.question_metrics(run, qrels).collect()


def test_metrics_by_hand(spark):
    m = measured(spark, ["x", "y", "g"], [["g"]])[0]
    assert (m.recall_1, m.recall_5, m.all_recall_5) == (0.0, 1.0, 1.0) and math.isclose(m.mrr_10, 1 / 3) and math.isclose(m.ndcg_10, 1 / math.log2(4))
    m = measured(spark, ["a", "b", "c"], [["a", "b", None], ["c"]])[0]
    assert m.recall_1 == 0.5 and math.isclose(m.ndcg_10, (1 + 1 / 2) / (1 + 1 / math.log2(3)))
    m = measured(spark, ["a", "v", "w", "x", "y", "b"], [["a"], ["b"]])[0]
    assert (m.recall_5, m.all_recall_5) == (0.5, 0.0)
    m = measured(spark, [], [["a"], ["b"]])[0]
    assert all(v == 0 for k, v in m.asDict().items() if k != "qid")
    assert measured(spark, ["a"], None) == [] and measured(spark, ["a"], [[], None]) == []
    run = frame(spark, [("q", "g", 1), ("q", "g", 4)], "qid string, doc string, rank int")
    qrels = metrics.judgements(frame(spark, [("q", [["g"]]), ("q", [["g"]])], "qid string, relevant_groups array<array<string>>"))
    assert metrics.first_hits(run, qrels).first().hit == 1
    asked = frame(spark, [("q",), ("r",)], "qid string")
    assert [r.qid for r in metrics.missing_questions(asked, run).collect()] == ["r"]


@SETTINGS
@given(st.permutations(list("abcdefghij")), st.lists(st.lists(st.sampled_from("abcdxyz"), max_size=3), min_size=1, max_size=3))
def test_recall_grows_with_k(spark, ranking, groups):
    for m in measured(spark, ranking, groups):
        assert m.recall_1 <= m.recall_5 <= m.recall_10 <= m.recall_20 and 0 <= m.ndcg_10 <= 1 + 1e-9 and m.all_recall_10 <= m.recall_10


def test_similarity_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [list(map(str, rng.integers(0, 30, 25))) for _ in range(8)]
    texts = base + [b[:20] + ["z"] + b[21:] for b in base] + [b[:] for b in base[:3]] + [["a", "b"], ["a", "b"], [], ["c"]]
    docs = frame(spark, [(f"d{i:02d}", t) for i, t in enumerate(texts)], "doc string, tokens array<string>")
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in texts]
    for t in (0.5, 0.8):
        want = {(f"d{i:02d}", f"d{j:02d}") for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a and b and len(a & b) / len(a | b) >= t}
        got = similarity.similar(docs, docs, t).collect()
        assert {(r["query"], r.doc) for r in got} == want and len(got) == len(want)
    gold = docs.filter("doc in ('d00', 'd22')")
    groups = similarity.relevance_groups(gold, similarity.similar(docs, gold)).orderBy("gold", "place").collect()
    assert groups[0].member == "d00" and {r.gold for r in groups} == {"d00", "d22"}


def corpus(spark):
    docs = frame(spark, [("a", "water plant"), ("b", "school meals"), ("c", "water meals")], "doc string, text string")
    asked = frame(spark, [("q", "water meals")], "qid string, text string")
    vectors = frame(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "doc string, vector array<float>")
    return grammar.Corpus({"en": docs, "ar": docs}, {"en": asked, "ar": asked}, {("e5", "ar"): vectors}, {("e5", "en"): frame(spark, [("q", [0.0, 1.0])], "qid string, vector array<float>")})


def test_grammar(spark):
    assert grammar.parse("rerank:hybrid:bm25-light+e5-base") == ("rerank", ["hybrid:bm25-light+e5-base"]) and grammar.parse("hybrid:a+b") == ("hybrid", ["a", "b"])
    for bad in ("bm25-x", "hybrid:a", "rerank:", "bm25", "", "other:a"):
        with pytest.raises(ValueError):
            grammar.parse(bad)
    c = corpus(spark)
    assert grammar.plan("bm25-raw", c, "en", "en").orderBy("rank").first().doc == "c"
    assert grammar.plan("hybrid:bm25-raw+bm25-norm", c, "en", "en").orderBy("rank").first().doc == "c"
    assert grammar.plan("rerank:bm25-raw", c, "en", "en").orderBy("rank").first().doc == "c"
    assert grammar.plan("e5", c, "en", "ar").orderBy("rank").first().doc == "b"
    for name, q, d in (("bm25-raw", "en", "ar"), ("e5", "en", "en")):
        with pytest.raises(ValueError):
            grammar.plan(name, c, q, d)


def test_ladder_and_table(spark):
    results = frame(spark, [("bm25-raw", "en-en", 0.8), ("bm25-raw", "ar-ar", 0.5), ("x", "en-en", 1.0)], "config string, pair string, value double")
    assert [tuple(r) for r in grammar.ladder(results).collect()] == [(0, "bm25-raw", 0.8, 0.5, 0.3)]
    assert grammar.markdown([{"a": 0.12345, "b": None, "c": 1234}], ["a", "b", "c"]) == "| a | b | c |\n|---|---|---|\n| 0.123 | – | 1,234 |"


def test_query_set_of_searches(spark):
    assert [r.i for r in retrieval.every(frame(spark, [(i,) for i in range(45)], "i int"), F.col("i")).orderBy("i").collect()] == [0, 20, 40]


def test_a_search_analyzes_the_documents_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for x in batches:
            seen.add(x.num_rows)
            yield x

    docs = frame(spark, [(f"d{i}", ["x", f"w{i}"]) for i in range(20)], "doc string, tokens array<string>").mapInArrow(counted, "doc string, tokens array<string>")
    asked = frame(spark, [(f"q{i}", ["x", f"w{i}"]) for i in range(12)], "qid string, tokens array<string>")
    for block in (1000, 2):
        seen.value = 0
        got = {r.qid: r.doc for r in retrieval.bm25(docs, asked, 3, block=block).filter("rank = 1").collect()}
        assert got == {f"q{i}": f"d{i}" for i in range(12)} and seen.value == 20


def test_a_task_gives_the_best_of_all_its_batches(spark):
    """Equal scores beyond k, in many batches of one task: the smaller documents, and hardly more rows than k leave the task."""
    rng = np.random.default_rng(5)
    kinds = [["x"], ["x", "y"], ["y"], ["x", "x", "z"], []]
    docs = frame(spark, [(f"d{i:04d}", kinds[rng.integers(0, 5)]) for i in rng.permutation(3000)], "doc string, tokens array<string>").coalesce(1)
    asked = frame(spark, [("a", ["x"]), ("b", ["y", "x"]), ("c", ["x", "y"]), ("d", ["z", "y"]), ("e", ["v"])], "qid string, tokens array<string>")
    whole = retrieval.top_k(retrieval.bm25_scores(docs, asked), 5)
    tidy = lambda df: sorted((r.qid, r["rank"], r.doc, round(r.score, 9)) for r in df.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert tidy(retrieval.bm25(docs, asked, 5)) == tidy(whole)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_what_is_kept_holds_the_best_of_each_query():
    rng = np.random.default_rng(7)
    score = np.round(rng.random(4000) * 20) * 1e-9 + np.where(rng.random(4000) < 0.1, 0.5e-9, 0) + 3
    query, rank = rng.integers(0, 7, 4000), rng.permutation(4000)
    kept, last = retrieval._kept(query, score, rank, 8, 10)
    for up in (0.0, 1e-12, -1e-12):  # whichever way the middle between two scores is rounded
        whole = np.rint((score + up) * 1e9)
        for q in range(7):
            its = np.flatnonzero(query == q)
            assert {*its[np.lexsort((rank[its], -whole[its]))][:10]} <= {*kept}
    assert last[7] == -np.inf


def test_few_terms_to_a_matrix(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MATRIX_TERMS", 4)
    rng = np.random.default_rng(9)
    docs = frame(spark, [(i, list(map(str, rng.integers(0, 20, 12)))) for i in range(200)], "doc bigint, tokens array<string>")
    asked = frame(spark, [(i, list(map(str, rng.integers(0, 20, 1 + i % 7)))) for i in range(40)], "qid bigint, tokens array<string>")
    tidy = lambda df: sorted((r.qid, r["rank"], r.doc, round(r.score, 9)) for r in df.collect())
    assert tidy(retrieval.bm25(docs, asked, 5)) == tidy(retrieval.top_k(retrieval.bm25_scores(docs, asked), 5))


def test_light_form_is_the_normal_form_stemmed(spark):
    texts = ["The Running’s 12٣ CITIES, Éclairs'", "ﬁnal ΟΔΟΣ İstanbul x́y", "والكِتَابُون وً َ ١٢٣ المكتبـات للࢌون", "aࢌb citiesࢌ", "", None, " ًٰ ", "١٢ running"]
    for lang in ("en", "ar"):
        df = frame(spark, [(i, x) for i, x in enumerate(texts)], "i int, text string")
        words = df.withColumn("w", T.tokens(F.coalesce("text", F.lit("")), lang)).select("i", F.posexplode("w").alias("at", "w"))
        stem = stemming.stem_arabic(F.col("w")) if lang == "ar" else stemming.stem_english(F.col("w"))
        want = {i: [] for i in range(len(texts))}
        for r in words.select("i", "at", stem.alias("s")).orderBy("i", "at").collect():
            want[r.i].append(r.s)
        assert {r.i: r.tokens for r in retrieval.analyze(df, "light", lang).collect()} == want
