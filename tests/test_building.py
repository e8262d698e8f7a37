import pytest
from pyspark.sql import functions as F

from qirtas.operators import appropriations, corpus, dense, ordered, similarity
from qirtas.plans import building

EN = [
    ("d1", 3, "Decides to appropriate to the Special Account for the United Nations Mission in Liberia the amount of 585,682,100 dollars for the period from 1 July 2009 to 30 June 2010, inclusive of 1 dollar"),
    ("d1", 9, "Decides to appropriate an additional amount of 2,500 dollars for the period from 1 May 2001 to 30 June 2001"),
    ("d2", 1, "Financing of the United Nations Mission in Liberia. The General Assembly notes it."),
    ("d2", 4, "Decides to appropriate to the Special Account for the Mission the amount of 7 million dollars for the period from 1 July 2009 to 30 June 2010;"),
    ("d3", 1, "Decides to appropriate the amount of 8,000 dollars for the period from 1 July 2009 to 30 June 2010;"), ("d3", 2, None), ("d3", 3, ""),
    ("d4", 1, "Decides to appropriate to the Special Account for the United Nations Force in Cyprus the amount of 9,100 dollars for the period from 1 July 2009 to 30 June 2010;"),
]
AR = [("d1", 1, "تخصص مبلغ 585 682 100 دولار"), ("d2", 1, "مبلغ 7 ملايين دولار"), ("d4", 1, "مبلغ ٩ ١٠٠ دولار"), ("d4", 2, None)]


def test_appropriation_records(spark, rows):
    en = spark.createDataFrame(EN + EN[:2], "doc_id string, first int, text string").withColumn("status", F.lit("clash"))
    ar = spark.createDataFrame(AR, "doc_id string, first int, text string")
    found = appropriations.records(en, ar)
    assert rows(found, "doc_id", "status", "amount") == [("d1", "additional", 2500), ("d1", "usable", 585682100), ("d2", "usable", 7000000), ("d3", "no_mission_name", 8000), ("d4", "usable", 9100)]
    firsts = appropriations.first_of_period(found)
    assert rows(firsts, "mission", "doc_id", "n_repeats") == [("united nations force in cyprus", "d4", 0), ("united nations mission in liberia", "d1", 1)]
    assert rows(appropriations.by_period(firsts)) == [("1 July 2009 - 30 June 2010", 2, 1, 1)]
    assert rows(appropriations.missions_per_period(appropriations.by_period(firsts))) == [(2, 1)]
    assert tuple(appropriations.verdict(firsts, 1).first()) == (2, 1, 1, 1, True) and not appropriations.verdict(firsts).first().enough
    nothing = appropriations.first_of_period(appropriations.records(en.limit(0), ar.limit(0)))
    assert tuple(appropriations.verdict(nothing, 1).first()) == (0, 0, 0, 0, False)


def test_financing_documents(spark, rows):
    s = spark.createDataFrame([("a", 1, "Financing of the Mission"), ("b", 41, "Financing of the Mission"), ("c", 2, None), ("a", 2, "financing of the Force")], "doc_id string, pos int, text string")
    assert rows(appropriations.financing_documents(s)) == [("a",)]
    paths = spark.createDataFrame([("1999/a/res/53_1",), ("1999/a/53_1",), (None,)], "doc_id string")
    assert rows(paths.filter(appropriations.is_resolution(F.col("doc_id")))) == [("1999/a/res/53_1",)]


def test_going_backwards_is_told_by_all_before(spark, rows):
    beads = spark.createDataFrame([("d", i, [s], ["x"]) for i, s in enumerate(["1:1", "1:5", "1:3", "1:4", "1:6", "9:9"])], "doc_id string, bead_no int, en array<string>, ar array<string>")
    sentences = spark.createDataFrame([("d", "en", f"1:{i}", i) for i in range(1, 8)] + [("d", "ar", "x", 1)], "doc_id string, lang string, sid string, pos int")
    assert rows(corpus.alignment_errors(beads, sentences)) == [("d", "ar", "not_monotonic", 5), ("d", "en", "missing", 1), ("d", "en", "not_monotonic", 2)]
    assert corpus.alignment_errors(beads.limit(0), sentences).count() == 0


@pytest.mark.parametrize("bucket", [2, 4096])
def test_highest_before(spark, bucket):
    data = [("g", i, v) for i, v in enumerate([3, 1, None, 5, 4, 2, 9, 1])] + [("h", 5, 7), ("h", 1, None)]
    got = {(r.k, r.o): r.m for r in ordered.highest_before(spark.createDataFrame(data, "k string, o int, v int"), ["k"], "o", "v", "m", bucket=bucket).collect()}
    assert [got["g", i] for i in range(8)] == [None, 3, 3, 3, 5, 5, 5, 9] and got["h", 1] is None and got["h", 5] is None


def test_numbering_in_ranges(spark):
    data = [("a", f"q{i:03d}") for i in range(200)] + [("b", f"q{i:03d}") for i in range(3)]
    got = ordered.numbered(spark.createDataFrame(data, "k string, q string").repartition(7), ["k"], "q", "i").collect()
    assert all(int(r.q[1:]) == r.i for r in got) and len(got) == 203
    assert ordered.numbered(spark.createDataFrame([], "k string, q string"), ["k"], "q", "i").count() == 0


def test_ties_at_the_last_place(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.5, 0.5]) for i in range(20)] + [(99, None)], "doc int, vector array<float>").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, vector array<float>")
    assert [r.doc for r in dense.exact_search(vectors, asked, 4).orderBy("rank").collect()] == [1, 3, 5, 7]
    assert dense.exact_search(vectors, asked, 50).count() == 20
    with pytest.raises(Exception, match="another length"):
        dense.exact_search(vectors.unionByName(spark.createDataFrame([(7, [1.0])], vectors.schema)), asked, 4).collect()


def test_crowded_shingles(spark, rows):
    docs = spark.createDataFrame([(f"d{i:02d}", "a b c d e f g h i j".split() + [f"x{i % 9}"]) for i in range(40)] + [("z", ["q"]), ("e", [])], "doc string, tokens array<string>")
    asked = docs.select("doc").filter("doc IN ('d00', 'z')")
    assert rows(similarity.similar(docs, asked, crowd_size=5)) == rows(similarity.similar(docs, asked)) and similarity.similar(docs, asked).count() > 3


def test_every_building_query_has_a_name_of_its_own():
    from qirtas.plans import queries

    assert not set(building.QUERIES) & set(queries.QUERIES) and set(building.SQL) <= set(building.QUERIES) | set(queries.QUERIES)
    assert not set(building.SQL) & set(queries.SQL)


# --- stores and steps ---


@pytest.fixture
def server(tmp_path):
    """An HTTP server of tmp_path that answers range requests, failing on each first request of a path."""
    import http.server
    import threading

    seen = set()

    class Handler(http.server.BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_HEAD(self):
            self.do_GET()

        def do_GET(self):
            path = tmp_path / self.path.strip("/")
            if not path.exists():
                self.send_error(404)
                return
            data = path.read_bytes()
            if (self.path, self.headers.get("Range")) not in seen and self.command == "GET" and self.headers.get("Range"):
                seen.add((self.path, self.headers.get("Range")))
                self.send_error(503)
                return
            status, whole = 200, data
            if span := self.headers.get("Range"):
                a, b = map(int, span.removeprefix("bytes=").split("-"))
                status, data = 206, whole[a : b + 1]
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            if self.command == "GET":
                self.wfile.write(data)

    httpd = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_address[1]}"
    httpd.shutdown()


def test_remote_archives(spark, tmp_path, server):
    import urllib.error
    import zipfile

    from qirtas.sources import archive

    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(5):
            z.writestr(f"en/{i}.txt", f"text {i} " * 50)
        with z.open(zipfile.ZipInfo("en/wide.txt"), "w", force_zip64=True) as f:
            f.write(b"wide")
    want = {f"en/{i}.txt": f"text {i} " * 50 for i in range(5)} | {"en/wide.txt": "wide"}
    naps = []
    with archive.Ranges(f"{server}/a.zip", naps.append) as source:
        found = {e[0]: archive.member(source, e).decode() for e in archive.directory(str(tmp_path / "a.zip"))}
    assert found == want and naps
    with pytest.raises(urllib.error.HTTPError):
        archive.Ranges(f"{server}/none.zip").length()
    rows = archive.read_archive(spark, str(tmp_path / "a.zip"), "en/").collect()
    assert {r.name: bytes(r.content).decode() for r in rows} == want
    assert archive.download(f"{server}/a.zip", str(tmp_path / "copy.zip"), 100) == (tmp_path / "a.zip").stat().st_size and (tmp_path / "copy.zip").read_bytes() == (tmp_path / "a.zip").read_bytes()


def test_wide_archive_records(tmp_path):
    import struct

    from qirtas.sources import archive

    # one member whose sizes and place stand in the wider fields, and a wider end record
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 0) + b"n" + b"body"
    crc = __import__("zlib").crc32(b"body")
    extra = struct.pack("<HHQQQ", 1, 24, 4, 4, 0)
    central = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, crc, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"n" + extra
    wide = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, len(local) + len(central), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    (tmp_path / "w.zip").write_bytes(local + central + wide + locator + end)
    entries = archive.directory(str(tmp_path / "w.zip"))
    with archive.Ranges(str(tmp_path / "w.zip")) as source:
        assert [e[0] for e in entries] == ["n"] and archive.member(source, entries[0]) == b"body"


def test_frozen_and_replaced_tables(spark, tmp_path):
    from qirtas.sources import files

    path = str(tmp_path / "t.jsonl")
    files.write_jsonl(spark.createDataFrame([(1,)], "a int"), path)
    files.write_jsonl(spark.createDataFrame([(2,), (3,)], "a int"), path)
    assert sorted(r.a for r in files.read_jsonl(spark, path, "a int").collect()) == [2, 3]
    with pytest.raises(files.Frozen):
        files.write_jsonl(spark.createDataFrame([(4,)], "a int"), path, frozen=True)
    assert files.read_jsonl(spark, path, "a int").count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t.jsonl"]
    assert files.environment(["json", "no_such_module"]) == ["module no_such_module"]


def test_vectors_are_made_once(spark, tmp_path):
    from qirtas.sources import stores

    texts = spark.createDataFrame([("a", "x"), ("b", None)], "id string, text string")
    made = []

    def encode(df):
        made.append(1)
        return dense.encode(df, lambda batch: [[3.0, 4.0] for _ in batch])

    for _ in range(2):
        got = {r.id: r.vector for r in stores.vectors_of(texts, str(tmp_path), "k1", encode).collect()}
    assert made == [1] and got["b"] is None and [round(x, 3) for x in got["a"]] == [0.6, 0.8]
    stores.vectors_of(texts, str(tmp_path), "k2", encode)
    assert len(made) == 2


def test_allowance_and_judging(spark, rows):
    from qirtas.operators import answers, contexts

    prompts = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)], "key string, n int")
    cache = spark.createDataFrame([("c", "x"), ("c", "y")], "key string, response string")
    kept = [answers.within_allowance(prompts, cache, m).collect() for m in (0, 1, 5)]
    assert [r.n for r in kept[0]] == [4] and len({r.key for r in kept[1]}) == 2 and sorted(r.n for r in kept[2]) == [1, 2, 3, 4]
    data = [(1, False, ["x"], "yes", "yes"), (2, True, ["x"], "yes", "yes"), (3, None, [], "yes", "yes"), (4, False, ["x"], "prose", "no"), (5, False, None, None, None)]
    judged = answers.judge_with(spark.createDataFrame(data, "i int, abstained boolean, context_ids array<string>, correctness_prompt string, support_prompt string"), lambda asked: ['so: {"correct": "true", "supported": true}' if a == "yes" else "well" for a in asked])
    assert rows(judged, "i", "correct", "supported") == [(1, True, True), (2, False, None), (3, True, None), (4, False, False), (5, False, None)]
    own = spark.createDataFrame([("q", ["b", "gone", "a"]), ("e", []), ("n", None)], "qid string, context_ids array<string>")
    corpus_rows = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", "B")], "chunk_id string, ar string")
    assert {r.qid: r.passages for r in contexts.passages_of(own, corpus_rows, "ar").collect()} == {"q": ["B", "A"], "e": [], "n": []}


def test_model_steps(spark):
    from qirtas.operators import questions
    from qirtas.plans import grammar

    df = spark.createDataFrame([(1, "Who?", None, "numeric"), (2, "What?", "bridge", "x")], "i int, q string, kind string, type string")
    got = {r.i: r.o for r in questions.asked(df, "Say $what", {"what": F.col("q")}, lambda p: f'{{"said": "{p}"}}' if "Who" in p else "no", "said string", "o").collect()}
    assert got[1].said == "Say Who?" and (got[2] is None or got[2].said is None)
    assert [r[0] for r in df.orderBy("i").select(questions.kind_of(df)).collect()] == ["numeric", "bridge"]
    texts, t = questions.prepare(spark.createDataFrame([("The 5", "the 5", "false"), ("a", "b", "true"), ("", "", "no")], "x string, y string, j string"), {"x": "en", "y": "en"})
    assert [r[0] for r in texts.select(questions.same_answer(t["x"], t["y"])).collect()] == [True, False, False]
    assert [r[0] for r in texts.select(questions.same_answer(t["x"], t["y"], F.col("j"))).collect()] == [True, True, False]
    assert grammar.questions_of("unpc") == grammar.questions_of("unpc_uncorrected")
    with pytest.raises(ValueError):
        grammar.questions_of("none")
