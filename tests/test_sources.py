import datetime as dt
import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from qirtas.operators import lineage
from qirtas.sources import archive, corpora, files, stores
from qirtas.streaming import ledger


def test_json_lines(spark, tmp_path, rows):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "x", "n": 1, "more": [1]}\n\n{"id": "y"}\n', encoding="utf-8")
    read = files.read_jsonl(spark, str(p), "id string, n int, more array<int>")
    assert rows(read, "id", "n") == [("x", 1), ("y", None)]
    assert files.read_jsonl(spark, str(p), "id string, n int", ["id"]).columns == ["id"]
    assert rows(files.read_keyed(spark, str(p), "id string, n int", "id", spark.createDataFrame([("y",), ("y",), ("z",)], "id string"))) == [("y", None)]
    files.write_jsonl(read, str(tmp_path / "out"))
    files.write_jsonl(read, str(tmp_path / "out"))
    assert rows(files.read_jsonl(spark, str(tmp_path / "out"), "id string, n int, more array<int>"), "id") == [("x",), ("y",)]
    p.write_text("{broken\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(p), "id string").collect()


def test_fingerprints_pass_over_line_ends(spark, tmp_path):
    (tmp_path / "lf").write_bytes(b"a\nb\n")
    (tmp_path / "crlf").write_bytes(b"a\r\nb\r\n")
    (tmp_path / "other").write_bytes(b"b\na\n")
    one, two, three = (files.fingerprint(spark, str(tmp_path / n)) for n in ("lf", "crlf", "other"))
    assert one == two != three
    hashes = files.file_hashes(spark, str(tmp_path / "lf"))
    good = hashes.first().sha256
    assert files.check_pinned(hashes, {"lf": good}).count() == 0
    assert {r.name for r in files.check_pinned(hashes, {"lf": "0", "gone": good}).collect()} == {"lf", "gone"}


def test_tables_and_reports(spark, tmp_path, rows):
    p = tmp_path / "pairs.tsv"
    p.write_text("doc_id\tdoc_score\tn_links\tn_one_to_one\na\t\t3\t2\nb\t0.5\t1\t1\n", encoding="utf-8")
    assert rows(files.read_pairs(spark, str(p))) == [("a", None, 3, 2), ("b", 0.5, 1, 1)]
    files.write_tsv(files.read_pairs(spark, str(p)), str(tmp_path / "t"))
    assert files.read_pairs(spark, str(tmp_path / "t")).count() == 2
    files.report(spark.createDataFrame([("é", 1)], "a string, n int"), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == [{"a": "é", "n": 1}]
    with pytest.raises(ValueError):
        files.report(spark.range(5), str(tmp_path / "r.json"), most=4)
    a, b = spark.createDataFrame([("q1", "first")], "qid string, why string"), spark.createDataFrame([("q1", "second", 2), ("q2", 'say "x"', None)], "qid string, why string, n int")
    files.write_audit([a, b], "qid", str(tmp_path / "audit"))
    text = "".join(x.read_text(encoding="utf-8") for x in sorted((tmp_path / "audit").glob("part*")))
    assert text.startswith("﻿qid,why,n\n") and "q1,first" in text and "second" not in text


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# no\nA=1\nB='two'\nbroken\n")
    assert files.load_env(str(tmp_path / ".env"), {"A": "0"}) == {"A": "0", "B": "two"} and files.load_env(str(tmp_path / "none"), {}) == {}
    (tmp_path / "c.json").write_text('{"a": {"b": [1]}}')
    assert files.read_config(str(tmp_path / "c.json")) == {"a": {"b": [1]}}


XML = """<TEI><teiHeader><publicationStmt><date> 1992 </date></publicationStmt><idno type="symbol">A/47/10</idno><keywords><term>WATER</term><term> </term></keywords><p id="0"><s id="0:1">header</s></p></teiHeader>
<text><body><p id="1"><s id="1:1">One  <hi>two</hi>
 three.</s><s id="1:2">Four.</s></p><p id="2"><s id="2:1"/></p></body></text></TEI>"""


def test_documents(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML, encoding="utf-8")
    (tmp_path / "b.xml").write_text("<broken", encoding="utf-8")
    (tmp_path / "d.xml").write_text("<TEI/>", encoding="utf-8")
    got = {r.path.rsplit("/", 1)[1]: r for r in corpora.read_documents(spark, str(tmp_path)).collect()}
    a = got["a.xml"]
    assert (a.symbol, a.date, a.keywords) == ("A/47/10", "1992", ["WATER"])
    assert [(s.sid, s.pid, s.pos, s.text) for s in a.sentences] == [("1:1", "1", 1, "One two three."), ("1:2", "1", 2, "Four."), ("2:1", "2", 3, "")]
    assert got["b.xml"].error and got["d.xml"].sentences == [] and got["d.xml"].symbol is None
    empty = spark.createDataFrame([("x", b""), ("y", None)], "path string, content binary")
    assert all(r.error for r in corpora.parse_documents(empty).collect())
    assert corpora.sentences(corpora.read_documents(spark, str(tmp_path)).filter("error IS NULL")).count() == 3


LINKS = """<?xml version="1.0"?><cesAlign>
<linkGrp fromDoc="ar/1990/a/1.xml.gz" toDoc="en/1990/a/1.xml.gz" score="0.5">
<link type="1-2" xtargets="1:1;1:1 1:2"/>
<link type="1-0" xtargets="2:1;"/>
</linkGrp>
<linkGrp fromDoc="ar/1990/a/2.xml.gz" toDoc="en/1990/a/3.xml.gz">
<link xtargets="1:1;1:1"/>
</linkGrp></cesAlign>"""


def test_alignment_links(spark, tmp_path, rows):
    with gzip.open(tmp_path / "ar-en.xml.gz", "wt", encoding="utf-8") as f:
        f.write(LINKS)
    links = corpora.read_links(spark, str(tmp_path / "ar-en.xml.gz"))
    assert rows(links.filter("score = 0.5"), "place", "ar", "en") == [(0, ["1:1"], ["1:1", "1:2"]), (1, ["2:1"], [])]
    assert links.count() == 3
    wanted = spark.createDataFrame([("1990/a/1",), ("1990/a/3",)], "doc_id string")
    assert corpora.read_links(spark, str(tmp_path / "ar-en.xml.gz"), wanted).count() == 2
    one = spark.createDataFrame([("fr/x.xml", "a b")], "p string, t string")
    for bad in (corpora.doc_id(F.col("p"), "en"), corpora.targets(F.col("t"), 0)):
        with pytest.raises(Exception, match="not"):
            one.select(bad).collect()


def questions_file(path, ids=("1", "2"), paragraphs=1):
    data = [{"paragraphs": [{"context": "c", "qas": [{"id": i, "question": f"q{i}", "answers": [{"text": "a"}]} for i in ids]}] * paragraphs}]
    path.write_text(json.dumps({"data": data}), encoding="utf-8")
    return str(path)


def test_parallel_questions(spark, tmp_path):
    en, ar = questions_file(tmp_path / "en.json"), questions_file(tmp_path / "ar.json")
    passages, asked = corpora.read_parallel_questions(spark, en, ar)
    assert passages.first().chunk_id == "xquad/00/00" and passages.count() == 1
    q = asked.orderBy("qid").first()
    assert (q.qid, q.question.ar, q.answer.en, q.relevant_groups) == ("xquad-1", "q1", "a", [["xquad/00/00"]])
    with pytest.raises(Exception, match="differ"):
        corpora.read_parallel_questions(spark, en, questions_file(tmp_path / "x.json", ("1", "3")))[1].collect()
    with pytest.raises(Exception, match="differ"):
        corpora.read_parallel_questions(spark, en, questions_file(tmp_path / "y.json", ("1",)))[1].collect()
    with pytest.raises(Exception, match="differ"):
        corpora.read_parallel_questions(spark, en, questions_file(tmp_path / "z.json", paragraphs=2))[0].collect()


def test_archives(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("en/a.xml", b"x" * 5000, zipfile.ZIP_DEFLATED)
        z.writestr("en/b.xml", b"stored", zipfile.ZIP_STORED)
        z.writestr("ar/c.xml", b"", zipfile.ZIP_DEFLATED)
        z.mkdir("en/empty")
    got = {r.name: (r.size, bytes(r.content)) for r in archive.read_archive(spark, str(path)).collect()}
    assert got == {"en/a.xml": (5000, b"x" * 5000), "en/b.xml": (6, b"stored"), "ar/c.xml": (0, b"")}
    assert {r.name for r in archive.read_archive(spark, str(path), "ar/").collect()} == {"ar/c.xml"}
    data = path.read_bytes()
    path.write_bytes(data.replace(b"stored", b"storeX", 1))
    with pytest.raises(Exception, match="checksum"):
        archive.read_archive(spark, str(path)).collect()
    path.write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError):
        archive.directory(str(path))


def test_runs(spark, tmp_path, rows):
    run = spark.createDataFrame([("q", "d", 0.123456789, 1)], "qid string, doc string, score double, rank int")
    stores.write_run(run, str(tmp_path), "unpc", "hybrid:bm25-raw+e5", "en-en")
    stores.write_run(run, str(tmp_path), "unpc", "bm25-raw", "ar-ar")
    stores.write_run(run, str(tmp_path), "unpc", "bm25-raw", "ar-ar")
    assert rows(stores.read_runs(spark, str(tmp_path)), "config", "pair", "score") == [("bm25-raw", "ar-ar", 0.123457), ("hybrid_bm25-raw__e5", "en-en", 0.123457)]


def test_response_cache(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "p string").withColumn("key", stores.request_key(F.lit("e"), F.lit("m"), F.col("p"), F.lit("{}")))
    key = asked.first().key
    assert len(key) == 64 and asked.select("key").distinct().count() == 2
    cache = spark.createDataFrame([(key, "yes"), (key, "zes")], "key string, response string")
    assert [r.response for r in stores.look_up(asked, cache).orderBy("p").collect()] == ["yes", None]
    calls = spark.createDataFrame([("k", "p"), ("k", "p"), ("l", None)], "key string, prompt string")
    assert [r.response for r in stores.ask_all(calls, lambda p: p.upper()).collect()] == ["P", "P", None]
    assert stores.python_key("e", "m", [], {"t": 0}) != stores.python_key("e", "m", [], {"t": 1})


def scripted(*steps):
    todo = list(steps)

    def call():
        step = todo.pop(0)
        if isinstance(step, Exception):
            raise step
        return step

    return call


def test_chat_through_the_cache():
    cache, book, slept = {}, [], []
    answer = {"text": "hi", "usage": {"prompt_tokens": 3, "completion_tokens": 1}}
    assert stores.chat("k", scripted(stores.RateLimited(3.0), stores.ServerError(), answer), cache, book, sleep=slept.append) == {**answer, "cached": False}
    assert slept == [3.0, 2.0] and book == [{"key": "k", "prompt_tokens": 3, "completion_tokens": 1}]
    assert stores.chat("k", scripted(), cache, book)["cached"] and len(book) == 1
    assert stores.chat("j", scripted(stores.InvalidJson()), cache, book)["text"] == "" and stores.chat("j", scripted(), cache, book)["cached"]
    for limit in (stores.RateLimited(per_day=True), stores.RateLimited(999.0)):
        with pytest.raises(stores.DailyLimit):
            stores.chat("x", scripted(limit), cache, book, sleep=slept.append)
    with pytest.raises(PermissionError):
        stores.chat("x", scripted(PermissionError()), cache, book)
    with pytest.raises(stores.ServerError):
        stores.chat("x", scripted(*[stores.ServerError()] * 3), cache, book, tries=3, sleep=slept.append)


def test_ledger_stream(spark, tmp_path, rows):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    entry = lambda day, key, n: (dt.datetime(2024, 1, day, 12), "m", key, n, 1)
    stores.append(spark.createDataFrame([entry(1, "a", 5), entry(1, "a", 5), entry(9, "b", 7)], ledger.ENTRY), source)
    usage = lambda: ledger.run_available(ledger.usage_by_window(ledger.read_ledger(spark, source)), target, checkpoint)
    usage()
    assert rows(spark.read.parquet(target), "calls", "prompt_tokens") == [(1, 5)]
    stores.append(spark.createDataFrame([entry(20, "c", 1), entry(1, "late", 100)], ledger.ENTRY), source)
    usage()
    assert rows(spark.read.parquet(target), "calls", "prompt_tokens") == [(1, 5), (1, 7)]
    usage()
    assert spark.read.parquet(target).count() == 2


def test_lineage(spark):
    df = spark.range(10)
    table = lineage.materialize(df)
    assert table.count() == 10 and "range" not in table._jdf.queryExecution().toString().lower()
    assert lineage.shared_folder(spark).startswith("file:")
    assert "broadcast" in lineage.small_or_not(table)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in lineage.small_or_not(table, 9)._jdf.queryExecution().toString().lower()
    assert lineage.spread(table.coalesce(1)).rdd.getNumPartitions() >= 4
    lineage.drop_table(table)
    with pytest.raises(Exception, match="(?i)not exist|FAILED_READ"):
        table.collect()
