import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qirtas.functions import text as T
from qirtas.llm import groups, neardup, queries, shingles, splitting

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def sets_of(texts, lang):
    import re

    out = []
    for t in texts:
        w = re.findall(r"\w+", T.normalize(t or "", lang))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abc أُإـةىé éٔﷺΣ٣３ _-\n"), max_size=40), max_size=5), st.sampled_from(T.LANGS))
def test_shingles_equal_the_normal_form(texts, lang):
    value, before = shingles.shingles(pa.array(texts, pa.string()), lang)
    want = sets_of(texts, lang)
    assert np.diff(before).tolist() == [len(s) for s in want]
    mine = [set(value[a:b].tolist()) for a, b in zip(before[:-1], before[1:], strict=True)]
    for i, a in enumerate(want):
        for j, b in enumerate(want):
            assert len(mine[i] & mine[j]) == len(a & b)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 160))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            edited = base[:]
            for _ in range(rng.randrange(1, 5)):
                k = rng.randrange(len(edited))
                edited[k : k + rng.randrange(2)] = [rng.choice(vocabulary)]
            texts.append(" ".join(edited))
    texts += [texts[0].upper(), texts[0] + "!", "one two", "One, two", "", None, " . ", "word"]
    want = set()
    s = sets_of(texts, "en")
    for i, a in enumerate(s):
        for j, b in enumerate(s):
            if i < j and a and b and len(a & b) / len(a | b) >= 0.8:
                want.add(tuple(sorted((f"d{i:03d}", f"d{j:03d}"))))
    df = spark.createDataFrame([(f"d{i:03d}", "en", t, 7) for i, t in enumerate(texts)] + [("d000", "en", texts[0], 7), (None, "en", "x", 7), ("z", None, "x", 7)], "id string, lang string, text string, class int").repartition(4)
    members, links = neardup.near_duplicates(df)
    got = [(r.id_1, r.id_2) for r in neardup.pairs_of_ids(members, links).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 20
    table = {r.id: r for r in neardup.classes(members, links).collect()}
    assert table["d000"].n_copies == 3 and len(table) == sum(bool(x) for x in s)
    near = {}
    for r in table.values():
        near.setdefault(r.near, set()).add(r.id)
    parent = {x: x for x in table}
    for a, b in sorted(want):
        old, new = sorted((parent[a], parent[b]))[::-1]
        parent = {k: new if v == old else v for k, v in parent.items()}
    groups_wanted = {frozenset(k for k in parent if parent[k] == v) for v in parent.values()}
    assert set(map(frozenset, near.values())) == groups_wanted
    # groups without pairs: the same groups from fewer links
    some, few = neardup.near_groups(df)
    by_group = {}
    for r in neardup.classes(some, few).collect():
        by_group.setdefault(r.near, set()).add(r.id)
    assert set(map(frozenset, by_group.values())) == groups_wanted and few.count() <= links.count()
    for make in (neardup.near_duplicates, neardup.near_groups):
        members, links = make(df.limit(0))
        assert neardup.pairs_of_ids(members, links).count() == 0 and neardup.classes(members, links).count() == 0


def test_languages_are_not_compared(spark):
    text = "the committee took note of the report on the water plant and the school meals of the northern district"
    close = text.replace("northern", "southern") + " and closed its session there"
    rows = [("a", "en", text), ("b", "ar", text), ("c", "es", text), ("d", "en", text + " x"), ("a", "en", close * 3), ("e", "en", close * 3)]
    df = spark.createDataFrame(rows, "id string, lang string, text string")
    members, links = neardup.near_duplicates(df)
    assert {(r.id_1, r.id_2) for r in neardup.pairs_of_ids(members, links).collect()} == {("a", "d"), ("a", "e")}
    assert len({r["class"] for r in members.filter("id IN ('b', 'c')").collect()}) == 2


def test_a_band_of_many_texts_makes_no_pairs(spark, monkeypatch):
    base = [f"word{i}" for i in range(400)]
    rows = [(f"n{i:03d}", "en", " ".join([*base[:200], f"own{i}", *base[201:]])) for i in range(120)] + [(f"o{i}", "en", " ".join(f"x{i}y{k}" for k in range(50))) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, lang string, text string")
    members, links = neardup.near_groups(df)
    assert links.count() < 3 * 120
    sizes = sorted(r.n for r in neardup.classes(members, links).groupBy("near").agg(F.count("*").alias("n")).collect())
    assert sizes == [1] * 60 + [120]
    monkeypatch.setattr(neardup, "BLOCK", 16)
    members, links = neardup.near_duplicates(df)
    assert links.count() == 120 * 119 // 2
    members, links = neardup.near_groups(df)
    assert sorted(r.n for r in neardup.classes(members, links).groupBy("near").agg(F.count("*").alias("n")).collect()) == sizes


def test_a_third_of_all_rows_the_same(spark):
    same = "the committee took note of the report on the water plant and the school"
    df = spark.createDataFrame([(f"s{i}", "en", same) for i in range(60)] + [(f"o{i}", "en", " ".join(f"x{i}y{k}" for k in range(30))) for i in range(120)], "id string, lang string, text string")
    members, links = neardup.near_duplicates(df)
    assert links.count() == 0 and neardup.pairs_of_ids(members, links).count() == 60 * 59 // 2 and members.select("class").distinct().count() == 121


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(2)
    for j in (0.95, 0.8, 0.5):
        found = []
        for _ in range(40):
            n = 300
            shared = rng.integers(0, 1 << 63, int(n * 2 * j / (1 + j)), dtype=np.uint64)
            rows = [np.unique(np.concatenate((shared, rng.integers(0, 1 << 63, n - len(shared), dtype=np.uint64)))) for _ in range(2)]
            _, sketch = neardup.signatures(np.concatenate(rows), np.array([0, len(rows[0]), len(rows[0]) + len(rows[1])]))
            found.append(neardup.estimate(np.array([sum(int(x).bit_count() for x in sketch[0] ^ sketch[1])]))[0])
        assert abs(np.mean(found) - j) < 0.05 and min(found) > j - neardup.MARGIN


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_groups_equal_union_find(spark, edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    named = [(f"n{a:02d}", f"n{b:02d}") for a, b in edges]
    for a, b in named:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*named, ("n99", None), (None, None)], "a string, b string")
    got = {r.node: r.label for r in groups.connected(df).collect()}
    assert got == {**{x: find(x) for x in list(parent)}, "n99": "n99"}


def test_long_chains_and_hubs(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(200)]
    hub = [("h", f"x{i:04d}") for i in range(400)]
    got = {r.node: r.label for r in groups.connected(spark.createDataFrame(chain + hub + hub, "a string, b string")).collect()}
    assert {v for k, v in got.items() if k[0] == "c"} == {"c0000"} and {v for k, v in got.items() if k[0] in "hx"} == {"h"}
    assert groups.connected(spark.createDataFrame([], "a string, b string")).count() == 0


def test_groups_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(groups, "BROADCAST_ROWS", 0)
    edges = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)] + [("h", f"x{i:02d}") for i in range(40)]
    got = {r.node: r.label for r in groups.connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**{f"c{i:02d}": "c00" for i in range(31)}, "h": "h", **{f"x{i:02d}": "h" for i in range(40)}}


def test_links_of_questions(spark, rows):
    data = [("q1", ["a", "b"], [["c", None, "a"], None]), ("q2", ["d"], None), ("q3", None, [["e", "f"], []]), ("q4", [None, "g"], [["b"], ["g", "g"], ["z"]]), ("q1", ["a", "b"], [["c", None, "a"], None]), ("q5", None, None)]
    df = spark.createDataFrame(data, "qid string, gold_chunks array<string>, relevant_groups array<array<string>>")
    assert rows(groups.question_links(df)) == [("a", "a"), ("a", "c"), ("b", "b"), ("d", "d"), ("e", "e"), ("e", "f"), ("g", "g"), ("z", "z")]


# --- splitting ---


@SETTINGS
@given(st.lists(st.text(st.sampled_from("abcd .,\n؟é́\U0001f600"), min_size=1, max_size=400), min_size=1, max_size=4), st.integers(20, 60), st.integers(0, 10))
def test_pieces_are_within_the_limit_and_join_to_the_text(spark, texts, limit, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {}
    for r in splitting.split(df, ["k"], limit, overlap).collect():
        got.setdefault(r.k, {})[r.piece_no] = r
    assert set(got) == {i for i, t in enumerate(texts) if len(t) > limit}
    for k, pieces in got.items():
        ordered = [pieces[i] for i in range(len(pieces))]
        assert all(0 < len(p.piece) <= limit and p.overlap_chars <= overlap for p in ordered) and ordered[0].overlap_chars == 0
        assert "".join(p.piece[p.overlap_chars :] for p in ordered) == texts[k]
        for a, b in zip(ordered, ordered[1:], strict=False):
            assert a.piece.endswith(b.piece[: b.overlap_chars])


def test_strong_boundaries_come_first(spark):
    text = "First words here. " + "More words follow, and go on without an end to " * 2 + "x"
    one = spark.createDataFrame([(1, text), (2, "a" * 100), (3, "short"), (4, None), (5, "")], "k int, text string")
    got = [r.piece for r in splitting.split(one, ["k"], 40, 8).filter("k = 1").orderBy("piece_no").collect()]
    assert got[0] == "First words here. " and all(len(p) <= 40 for p in got)
    assert [len(r.piece) for r in splitting.split(one, ["k"], 40, 8).filter("k = 2").orderBy("piece_no").collect()] == [32, 40, 40, 12]
    assert {r.k for r in splitting.split(one, ["k"], 40, 8).collect()} == {1, 2}
    for bad in ((10, 10), (10, -1)):
        with pytest.raises(ValueError):
            splitting.pattern(*bad)


def test_a_run_that_fits_is_not_torn(spark):
    link = "h" * 500
    texts = ["See the page. " + link + " and so on " + link + " to the end.", "Row\n" + "x" * 700 + "\n" + "y" * 719 + " end", "a " + "z" * 1500]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    own = [[p["part"] for p in r.p] for r in df.select(splitting.parts(F.col("text"), 800, 80).alias("p"), "k").orderBy("k").collect()]
    assert ["".join(x) for x in own] == texts and all(len(p) <= 720 for x in own for p in x)
    assert own[0] == ["See the page. " + link + " and so on ", link + " to the end."] and own[1] == ["Row\n" + "x" * 700 + "\n", "y" * 719 + " ", "end"]
    link = "h" * 600
    text = "See " + "the page " * 30 + link + " and the end of it " * 10
    own = [p["part"] for p in spark.createDataFrame([(text,)], "text string").select(splitting.parts(F.col("text"), 800, 80).alias("p")).first().p]
    assert "".join(own) == text and any(link in p for p in own)


def test_very_long_items(spark):
    text = "Some words of a sentence, and more. " * 20_000
    got = splitting.split(spark.createDataFrame([(1, text)], "k int, text string"), ["k"], 2000).orderBy("piece_no").collect()
    assert "".join(r.piece[r.overlap_chars :] for r in got) == text and max(len(r.piece) for r in got) <= 2000


def tables(spark, bucket=None):
    rng = random.Random(9)
    now = dt.datetime(2024, 1, 1)
    sentences, beads = [], []
    for d in ("d1", "d2"):
        for i in range(60):
            for lang in T.LANGS:
                text = rng.choice([None, "", "x" * 900, "some words " * rng.randrange(1, 60), "y" * 700])
                sentences.append((d, lang, f"1:{i}", text, now))
                if rng.random() < 0.2:
                    sentences.append((d, lang, f"1:{i}", "old " * 300, now - dt.timedelta(1)))
            beads.append((d, i * 3 + 5, [f"1:{i}", None] if i % 5 else [], [f"1:{i}", f"9:{i}"] if i % 7 else None, rng.choice([True, False, False, None]), now))
    sentences += sentences[:5] + [(None, "en", "1:1", "z" * 999, now), ("d1", "en", "null", "z" * 801, None)]
    return sentences, beads + beads[:4] + [("d1", None, [], [], True, now)]


@pytest.mark.parametrize("bucket", [4, splitting.BUCKET])
def test_oversized_items_equal_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(splitting.run_ends, "__defaults__", (bucket,))
    sentences, beads = tables(spark)
    newest = {}
    for d, lang, sid, text, t in sentences:
        if d is not None and ((d, lang, sid) not in newest or (t is not None and t > newest[d, lang, sid][0])):
            newest[d, lang, sid] = (t, text)
    want = {("sentence", *k): v[1] for k, v in newest.items() if v[1] and len(v[1]) > 800}
    by_doc = {}
    for d, no, en, ar, end, _ in beads:
        if no is not None:
            by_doc.setdefault(d, {})[no] = (en, ar, end)
    for d, own in by_doc.items():
        now = {"en": [], "ar": []}
        for no in sorted(own):
            for lang, sids in zip(T.LANGS, own[no][:2], strict=True):
                now[lang] += [x for s in sids or [] if (x := newest.get((d, lang, s), (0, None))[1])]
            if own[no][2]:
                want |= {("run", d, lang, str(no)): " ".join(x) for lang, x in now.items() if len(" ".join(x)) > 2000}
                now = {"en": [], "ar": []}
    s = spark.createDataFrame(sentences, "doc_id string, lang string, sid string, text string, ingested_at timestamp_ntz")
    b = spark.createDataFrame(beads, "doc_id string, bead_no int, en array<string>, ar array<string>, paragraph_end boolean, ingested_at timestamp_ntz")
    got = {(r.unit, r.doc_id, r.lang, r.item_key): r.text for r in splitting.oversized_items(s, b).collect()}
    assert got == want and any(k[0] == "run" for k in want)
    pieces = splitting.split_oversized(s, b)
    assert {(r.unit, r.doc_id, r.lang, r.item_key) for r in pieces.filter("piece_no = 0").collect()} == set(want)
    assert splitting.split_oversized(s.limit(0), b.limit(0)).count() == 0


# --- registered queries ---


def test_queries_have_the_given_columns(spark):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data here")
    want = {
        "p1_found": "tbl string, record_id string, lang string, defect string", "p3_found": "unit string, doc_id string, lang string, item_key string", "p4_found": "chunk_id_1 string, chunk_id_2 string", "p5_found": "tbl string, record_id string, lang string",
        "p6_found": "chunk_id string, group_id string", "p7_ids": "doc_id bigint, ids array<int>", "p8_found": "doc_id bigint, item_id bigint", "p9_found": "doc_id bigint, pii_type string, pii_text string",
    }
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, folder)
        assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) == columns
        rows = df.groupBy(*df.columns).agg(F.count("*").alias("_n")).filter("_n > 1")
        assert rows.count() == 0
    for name in ("p2_token_counts", "p2_slice_totals", "p2_slice_ratios", "p3_pieces", "p4_classes", "p4_groups", "p5_values", "p8_items", "p9_texts", "p1_totals"):
        assert queries.QUERIES[name](spark, folder).count() > 0
