import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qirtas.functions import financing
from qirtas.functions import text as T
from qirtas.operators import corpus, ordered, sampling

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
NOW = dt.datetime(2024, 1, 1)


def packed(spark, ends, en, ar, target, most):
    beads = spark.createDataFrame([("d", i, e, x, y) for i, (e, x, y) in enumerate(zip(ends, en, ar, strict=True))], "doc_id string, bead_no int, paragraph_end boolean, en_tokens int, ar_tokens int")
    groups = {}
    for r in corpus.pack(beads, target, most).collect():
        groups.setdefault(r.grp, []).append(r.bead_no)
    return [sorted(groups[g]) for g in sorted(groups)]


def test_packing_by_hand(spark):
    assert packed(spark, [False] * 3, [100] * 3, [150] * 3, 1000, 350) == [[0, 1], [2]]
    assert packed(spark, [True, False, False], [100] * 3, [100] * 3, 100, 350) == [[0], [1, 2]]
    assert packed(spark, [True, True], [10, 10], [10, 10], 200, 350) == [[0, 1]]
    assert packed(spark, [False, False], [400, 10], [1, 1], 200, 350) == [[0], [1]]
    assert packed(spark, [None, None], [None, 5], [1, None], 200, 350) == [[0, 1]]


@SETTINGS
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=25))
def test_packing_covers_every_bead_and_keeps_the_limit(spark, beads):
    groups = packed(spark, *zip(*beads, strict=True), 30, 60)
    assert [i for g in groups for i in g] == list(range(len(beads)))
    for g in groups:
        assert len(g) == 1 or (sum(beads[i][1] for i in g) <= 60 and sum(beads[i][2] for i in g) <= 60)


def test_packing_of_many_documents_and_none(spark):
    many = spark.createDataFrame([(f"d{i % 7}", i, True, 150, 10) for i in range(700)], "doc_id string, bead_no int, paragraph_end boolean, en_tokens int, ar_tokens int")
    out = corpus.pack(many)
    assert out.count() == 700 and {r.n for r in out.groupBy("doc_id").agg(F.countDistinct("grp").alias("n")).collect()} == {50}
    assert corpus.pack(many.limit(0)).count() == 0


def sentences(spark, data):
    return spark.createDataFrame([(d, lang, f"{p}:{i}", str(p), i, t, NOW) for d, lang, p, i, t in data], "doc_id string, lang string, sid string, pid string, pos int, text string, ingested_at timestamp_ntz")


def test_beads_chunks_and_paragraphs(spark):
    s = sentences(spark, [("d", "en", 1, 1, "A."), ("d", "en", 1, 2, "B."), ("d", "en", 2, 3, "C."), ("d", "ar", 1, 1, "أ"), ("d", "ar", 2, 2, ""), ("d", "ar", 2, 3, None)])
    ends = corpus.paragraph_ends(corpus.newest_sentences(s))
    assert [(r.sid, r.last) for r in ends.filter("lang = 'en'").orderBy("pos").collect()] == [("1:1", False), ("1:2", True), ("2:3", True)]
    beads = spark.createDataFrame([("d", 1, ["1:1", "1:2"], ["1:1"], None, NOW), ("d", 2, ["2:3"], ["2:2"], True, NOW), ("d", 2, ["2:3"], ["2:2"], True, NOW)], "doc_id string, bead_no int, en array<string>, ar array<string>, paragraph_end boolean, ingested_at timestamp_ntz")
    texts = corpus.bead_texts(beads, s)
    assert [(r.bead_no, r.one_to_one, r.paragraph_end) for r in texts.orderBy("bead_no").collect()] == [(1, False, False), (2, True, True)]
    groups = spark.createDataFrame([("d", 1, 0), ("d", 2, 0)], "doc_id string, bead_no bigint, grp bigint")
    c = corpus.make_chunks(texts, groups).first()
    assert (c.chunk_id, c.en, c.ar, c.n_beads, c.one_to_one_ratio) == ("d#0000", "A. B.\nC.", "أ", 2, 0.5)
    assert [(r.pid, r.text) for r in corpus.paragraphs(s).filter("lang = 'en'").orderBy("first").collect()] == [("1", "A. B."), ("2", "C.")]


def test_alignment_errors(spark, rows):
    s = sentences(spark, [("d", "en", 1, i, "x") for i in (1, 2, 3)] + [("d", "ar", 1, 1, "x")])
    beads = spark.createDataFrame([("d", 1, ["1:2"], ["1:1"]), ("d", 2, ["1:1"], ["9:9"]), ("d", 3, None, [])], "doc_id string, bead_no int, en array<string>, ar array<string>")
    assert rows(corpus.alignment_errors(beads, s), "lang", "error", "n") == [("ar", "missing", 1), ("en", "not_monotonic", 1)]


@SETTINGS
@given(st.lists(st.integers(0, 60), min_size=1, max_size=30, unique=True), st.integers(1, 9))
def test_neighbours_across_buckets(spark, places, bucket):
    df = spark.createDataFrame([("g", p, str(p)) for p in places], "g string, p int, v string")
    order = sorted(places)
    nxt = {r.p: r.n for r in ordered.neighbour(df, ["g"], "p", "v", "n", bucket=bucket).collect()}
    prev = {r.p: r.n for r in ordered.neighbour(df, ["g"], "p", "v", "n", ahead=False, bucket=bucket).collect()}
    assert nxt == {p: (str(order[i + 1]) if i + 1 < len(order) else None) for i, p in enumerate(order)}
    assert prev == {p: (str(order[i - 1]) if i else None) for i, p in enumerate(order)}


def test_a_null_next_value_is_no_missing_row(spark):
    df = spark.createDataFrame([("g", 1, "a"), ("g", 2, None), ("g", 3, "c")], "g string, p int, v string")
    assert [r.n for r in ordered.neighbour(df, ["g"], "p", "v", "n").orderBy("p").collect()] == [None, "c", None]


def test_selection(spark, rows):
    pairs = spark.createDataFrame([("a", 40, 40), ("b", 50, 30), ("c", 0, 0), ("d", 40, None), ("e", 500, 450)], "doc_id string, n_links bigint, n_one_to_one bigint")
    assert rows(corpus.eligible(pairs), "doc_id") == [("a",)]
    docs = spark.createDataFrame([(f"d{i}",) for i in range(30)], "doc_id string")
    few, more = (corpus.in_hash_order(d, "s", 10) for d in (docs.filter("doc_id <> 'd7'"), docs))
    gone = {r.doc_id for r in few.collect()} - {r.doc_id for r in more.collect()}
    assert len(gone) <= 1
    links = spark.createDataFrame([("x", "x", 0.5, ["1"], ["1"]), ("x", "x", 0.5, [], ["2"]), ("y", "z", None, ["1"], ["1"])], "ar_doc string, en_doc string, score double, ar array<string>, en array<string>")
    assert rows(corpus.pair_index(links)) == [("x", 0.5, 2, 1)] and corpus.mismatched(links).first().n == 1


def test_citation_closure(spark, rows):
    seeds = spark.createDataFrame([("2000/a/1",), ("2000/a/2",)], "doc_id string")
    texts = spark.createDataFrame([("2000/a/1", "see A/9 and A/2"), ("2000/a/3", "see A/8"), ("2000/a/2", None)], "doc_id string, text string")
    cited = corpus.cited_keys(texts)
    filed = spark.createDataFrame([("a/9", "1999/a/9"), ("a/9", "2001/a/9"), ("a/2", "2000/a/2"), ("a/8", "2000/a/8")], "key string, doc_id string")
    assert rows(corpus.cited_closure(seeds, cited, filed, "s", 9)) == [("1999/a/9",), ("2001/a/9",)]
    assert corpus.cited_closure(seeds, cited, filed, "s", 1).count() == 1
    own = corpus.manifest(seeds, seeds.limit(0))
    assert corpus.manifest_difference(own, own).count() == 0 and corpus.manifest_difference(own, own.limit(1)).first().side == "ours"


def test_statistics(spark):
    c = spark.createDataFrame([("s", 10, 20), ("s", 600, 700), ("s", 600, 10), ("s", None, 513)], "source string, en_tokens int, ar_tokens int")
    assert tuple(corpus.truncation(c).first()) == (3, 1, 1, 1)
    p = corpus.length_percentiles(c, ["source"], "en_tokens").first()
    assert (p.p50, p.max) == (600.0, 600)
    r = corpus.token_ratio(c, ["source"]).first()
    assert round(r["median"], 4) == round(700 / 600, 4)
    n = spark.createDataFrame([("50,000", "000 50"), ("none", None), (None, "x")], "en string, ar string")
    fixed = corpus.repair_numbers(n)
    assert [(r.ar, r.numbers_corrected) for r in fixed.collect()] == [("50 000", 1), (None, 0), ("x", 0)]
    audited = corpus.audit_numbers(n.withColumn("ar_normal", T.normalized(F.col("ar"), "ar")))
    assert [tuple(r) for r in audited.collect()] == [("reversed_space", 1)]


LONG = "The committee took note of the report of the secretariat on the water plant and asked for a further note on the matter before the next session of the assembly. " * 3


def chunk_table(spark, data):
    return spark.createDataFrame([(f"{d}#{i:04d}", d, en, "نص", 1.0, False, n, k) for i, (d, en, n, k) in enumerate(data)], "chunk_id string, doc_id string, en string, ar string, one_to_one_ratio double, truncated_e5 boolean, numbers_corrected int, keywords array<string>")


def test_content_rules(spark):
    rules = sampling.RULES
    good = chunk_table(spark, [("d", LONG, 0, []), ("d", "short", 0, []), ("d", None, 0, []), ("d", "1. Water ........ 12\n" * 30 + LONG, 0, []), ("d", "123 456 789 " * 60, 0, [])])
    assert [r.chunk_id for r in good.filter(sampling.is_content(rules)).collect()] == ["d#0000"]
    assert good.withColumn("ar", F.lit(" ")).filter(sampling.is_content(rules)).count() == 0
    assert good.withColumn("truncated_e5", F.lit(True)).filter(sampling.is_content(rules)).count() == 0


def test_candidates(spark, rows):
    c = chunk_table(spark, [("a", LONG, 0, ["WATER (AFRICA)--PLANTS"]), ("a", LONG + "1,000 lamps", 1, None), ("b", LONG, 0, ["WATER PLANT--X"]), ("c", LONG, 0, ["WATER PLANT"]), ("e", LONG + "see A/B", 0, ["OTHER"])])
    assert rows(sampling.single_candidates(c, "s"), "doc_id") == [("a",), ("b",), ("c",), ("e",)]
    assert rows(sampling.single_candidates(c, "s", numeric=True), "chunk_id") == [("a#0001",)]
    options = sampling.comparison_options(c, 3)
    assert rows(options, "term", "doc_id") == [("WATER PLANT", "b"), ("WATER PLANT", "c")]
    assert [(r.doc_1, r.doc_2) for r in sampling.comparison_pairs(options, "s").collect()] == [("b", "c")]
    assert sampling.comparison_pairs(options.limit(0), "s").count() == 0


def test_pairs_equal_taking_them_one_by_one(spark):
    import hashlib
    import random

    rng = random.Random(5)
    data = sorted({(f"t{rng.randrange(8)}", f"d{rng.randrange(14):02d}") for _ in range(50)})
    size = {t: sum(x == t for x, _ in data) for t, _ in data}
    options = spark.createDataFrame([(t, size[t], d, d + "#0") for t, d in data], "term string, n_docs bigint, doc_id string, chunk_id string")
    used, want = set(), set()
    for _, _, _, t, a, b in sorted((size[t], t, hashlib.sha256(f"s|{a}|{b}".encode()).hexdigest(), t, a, b) for t, a in data for u, b in data if t == u and a < b):
        if not {a, b} & used:
            used |= {a, b}
            want.add((t, a, b))
    got = {(r.term, r.doc_1, r.doc_2) for r in sampling.comparison_pairs(options, "s").collect()}
    assert got == want


def test_bridges(spark):
    c = chunk_table(spark, [("2000/a/1", LONG + "as in document A/9.", 0, []), ("2000/a/9", LONG, 0, []), ("2000/a/2", LONG + "as in A/2", 0, [])])
    assert [(r.doc_a, r.symbol, r.doc_b) for r in sampling.bridge_candidates(c, "s").collect()] == [("2000/a/1", "A/9", "2000/a/9")]


FINANCE = [
    "Decides to appropriate to the Special Account for the United Nations Mission in Liberia the amount of 585,682,100 dollars for the period from 1 July 2009 to 30 June 2010, inclusive of 1 dollar",
    "Decides to appropriate the amount of 563 million dollars, gross, for the period from 1 July 2001 to 30 June 2002; and",
    "Decides also to apportion the amount of 1,000 dollars for the period from 1 July 2001 to 30 June 2002",
    "Decides to appropriate an additional amount of 2,500 dollars for the period from 1 May 2001 to 30 June 2001",
    "Decides to appropriate the amount of 8,260,509 dollars for the support account for the period from 1 July 2001 to 30 June 2002",
    "Decides to appropriate the amount of 1,000 dollars for the period from 1 July 1996 to 30 June 1997, in addition to the amount of 500 dollars already appropriated for it",
    "Decides to appropriate the amount of 1,000 dollars, inclusive of 5 for the period from 1 July 1996 to 30 June 1997",
]


def test_appropriations(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(FINANCE)], "i int, t string")
    got = [r.x for r in df.select("i", financing.appropriation(F.col("t")).alias("x")).orderBy("i").collect()]
    assert (got[0].amount, got[0].period, got[0].kind, got[0].mission) == (585682100, "1 July 2009 - 30 June 2010", "appropriation", "United Nations Mission in Liberia")
    assert (got[1].amount, got[1].mission) == (563_000_000, None)
    assert [g and g.kind for g in got[2:]] == [None, "additional", "support_account", "partial", None]
    amounts = spark.createDataFrame([("585,682,100",), ("6.5 million",), ("1.2 billion",)], "t string")
    assert [r[0] for r in amounts.select(financing.amount(F.col("t"))).collect()] == [585682100, 6500000, 1200000000]
    names = spark.createDataFrame([("Peace-keeping Force’s  (continued)",)], "t string")
    assert names.select(financing.canonical_mission(F.col("t"))).first()[0] == "peacekeeping force's"
    arabic = spark.createDataFrame([("مبلغ 35 689 968 دولار", "35,689,968"), ("مبلغ 563 مليون دولار", "563 million"), ("عدد 35 689 968", "35,689,968"), ("مبلغ 135 689 968", "35,689,968")], "t string, a string")
    assert [r[0] for r in arabic.withColumn("n", T.normalized(F.col("t"), "ar")).select(financing.confirms(F.col("n"), F.col("a"))).collect()] == [True, True, False, False]
    docs = spark.createDataFrame([(1, "Financing of the United Nations Mission in Liberia. Special Account for the United Nations Mission in Liberia. Financing of the Force")], "d int, text string")
    assert financing.document_missions(docs, "d").first().mission == "United Nations Mission in Liberia"


def test_headers_and_ids(spark):
    c = spark.createDataFrame([("h", "x", 7), (None, "x", 12345)], "header string, en string, k bigint")
    assert [r[0] for r in c.select(corpus.with_header(c, "en")).collect()] == ["h\nx", "x"]
    assert [r[0] for r in c.select(corpus.chunk_id(F.lit("d"), F.col("k"))).collect()] == ["d#0007", "d#12345"]
    two = spark.createDataFrame([("a", "b"), (" ", "b"), ("a", None)], "en string, ar string")
    assert corpus.both_sides(two).count() == 1
    assert pytest.approx(1.0) == spark.createDataFrame([(2, 2)], "n_links int, n_one_to_one int").select(corpus.ratio()).first()[0]


def one_by_one(en, ar, ends, target, most):
    out, e, a, grp, some = [], 0, 0, 0, False
    for x, y, end in zip(en, ar, ends, strict=True):
        if some and (e + x > most or a + y > most):
            e, a, grp, some = 0, 0, grp + 1, False
        out.append(grp)
        e, a, some = e + x, a + y, True
        if end and max(e, a) >= target:
            e, a, grp, some = 0, 0, grp + 1, False
    return out


def test_closings_equal_one_by_one():
    import random

    import numpy as np

    rng = random.Random(4)
    for _ in range(400):
        n = rng.randrange(1, 40)
        en, ar, ends = [rng.choice([0, 1, 3, 9, 25]) for _ in range(n)], [rng.choice([0, 2, 4, 8, 30]) for _ in range(n)], [rng.random() < 0.4 for _ in range(n)]
        target, most = rng.choice([(5, 12), (10, 20), (1, 1), (20, 20)])
        held, grp, out, at = (0, 0, False), 0, [], 0
        while at < n:  # in batches of any size
            step = rng.randrange(1, n + 1)
            own = slice(at, min(n, at + step))
            begins, held, closed = corpus._closings(np.array(en[own]), np.array(ar[own]), np.array(ends[own]), held, target, most)
            marks = np.zeros(own.stop - at, int)
            marks[begins] = 1
            out += (grp + np.cumsum(marks)).tolist()
            grp += len(begins) + closed
            at = own.stop
        assert out == one_by_one(en, ar, ends, target, most)
