"""Corpora in their own formats: aligned XML documents, alignment files, parallel question sets."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "symbol string, date string, keywords array<string>, sentences array<struct<sid: string, pid: string, pos: int, text: string>>"
LINKS = "_fromDoc string, _toDoc string, _score double, link array<struct<_xtargets: string>>"


def _document(data: bytes) -> tuple:
    """(symbol, date, keywords, sentences) of one XML document; what it lacks is NULL or empty."""
    root = ET.fromstring(data)

    def text_of(path: str) -> str | None:
        node = root.find(path)
        return (node.text or "").strip() or None if node is not None else None

    sentences = []
    body = root.find(".//body")
    for p in body.iter("p") if body is not None else ():
        for s in p.iter("s"):
            sentences.append((s.get("id", ""), p.get("id", ""), len(sentences) + 1, " ".join("".join(s.itertext()).split())))
    terms = [t.text.strip() for t in root.findall(".//keywords/term") if t.text and t.text.strip()]
    return text_of(".//idno[@type='symbol']"), text_of(".//publicationStmt/date"), terms, sentences


def parse_documents(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, symbol, date, keywords, sentences, error) of XML documents (key, content as bytes).

    Sentences come from the body alone, blanks collapsed, in order.  A document that is no XML has its error and NULL
    for the rest; empty content is such a document.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, data in zip(frame["key"], frame["content"], strict=True):
                try:
                    symbol, date, terms, sentences = _document(bytes(data) if data is not None else b"")
                    rows.append((k, symbol, date, terms, [dict(zip(("sid", "pid", "pos", "text"), s, strict=True)) for s in sentences], None))
                except ET.ParseError as e:
                    rows.append((k, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["key", "symbol", "date", "keywords", "sentences", "error"])

    out = files.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content")).mapInPandas(run, f"key string, {DOCUMENT}, error string")
    return out.withColumnRenamed("key", key)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return parse_documents(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def sentences(documents: DataFrame, key: str = "path") -> DataFrame:
    return documents.select(key, F.explode("sentences").alias("s")).select(key, "s.*")


def doc_id(path: Column, lang: str) -> Column:
    """The id in a path `lang/id.xml(.gz)`; a path outside the language's folder fails."""
    good = F.when(path.startswith(f"{lang}/"), F.regexp_replace(F.substring(path, len(lang) + 2, 1 << 30), r"\.xml(\.gz)?$", ""))
    return F.coalesce(good, F.raise_error(F.concat(F.lit(f"not a path of {lang}/: "), F.coalesce(path, F.lit("NULL")))).cast("string"))


def targets(value: Column, side: int) -> Column:
    """One side (0 or 1) of a link "a b;c"; anything but two sides fails."""
    parts = F.split(value, ";")
    checked = F.when(F.size(parts) == 2, parts[side]).otherwise(F.raise_error(F.concat(F.lit("not two sides: "), value)).cast("string"))
    return F.filter(F.split(F.trim(checked), r"\s+"), lambda x: x != "")


def read_links(spark: SparkSession, path: str, wanted: DataFrame | None = None, first: str = "ar", second: str = "en") -> DataFrame:
    """(ar_doc, en_doc, score, place, ar, en): one row per link of an alignment file (XML, also gzip'd), in order.

    With `wanted` (doc_id), other documents' links are dropped before they are taken apart.
    """
    rows = spark.read.format("xml").option("rowTag", "linkGrp").schema(LINKS).load(path)
    rows = rows.select(doc_id(F.col("_fromDoc"), first).alias(f"{first}_doc"), doc_id(F.col("_toDoc"), second).alias(f"{second}_doc"), F.col("_score").alias("score"), "link")
    if wanted is not None:
        rows = rows.filter(F.col(f"{first}_doc") == F.col(f"{second}_doc")).join(wanted.select(F.col("doc_id").alias(f"{second}_doc")), f"{second}_doc", "left_semi")
    each = rows.select(f"{first}_doc", f"{second}_doc", "score", F.posexplode("link").alias("place", "l"))
    return each.select(f"{first}_doc", f"{second}_doc", "score", "place", targets(F.col("l._xtargets"), 0).alias(first), targets(F.col("l._xtargets"), 1).alias(second))


QA = "data array<struct<paragraphs: array<struct<context: string, qas: array<struct<id: string, question: string, answers: array<struct<text: string>>>>>>>>"


def read_parallel_questions(spark: SparkSession, en_path: str, ar_path: str, source: str = "xquad") -> tuple[DataFrame, DataFrame]:
    """(passages, questions) of two parallel question files.

    Articles and paragraphs pair by place, questions by place and id; counts or ids that differ fail.
    """

    def paragraphs(path: str, lang: str) -> DataFrame:
        data = spark.read.schema(QA).option("multiLine", True).json(path).select(F.posexplode("data").alias("a", "article"))
        return data.select("a", F.posexplode("article.paragraphs").alias("p", "x")).select("a", "p", F.col("x.context").alias(lang), F.col("x.qas").alias(f"{lang}_qas"))

    def same(ok: Column, value: Column, what: str) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(what)).cast("string"))

    both = paragraphs(en_path, "en").join(paragraphs(ar_path, "ar"), ["a", "p"], "full_outer")
    doc = F.concat(F.lit(f"{source}/"), F.lpad(F.col("a").cast("string"), 2, "0"))
    chunk = F.concat(doc, F.lit("/"), F.lpad(F.col("p").cast("string"), 2, "0"))
    there = F.col("en").isNotNull() & F.col("ar").isNotNull()
    passages = both.select(same(there, chunk, f"{source}: the files differ in articles or paragraphs").alias("chunk_id"), doc.alias("doc_id"), "en", "ar")
    sides = [both.select("a", "p", F.posexplode(f"{x}_qas").alias("i", x)) for x in ("en", "ar")]
    pairs = sides[0].join(sides[1], ["a", "p", "i"], "full_outer")
    qid = same(F.col("en.id") == F.col("ar.id"), F.concat(F.lit(f"{source}-"), F.col("en.id")), f"{source}: questions differ in number or id")
    text = lambda f: F.struct(F.col(f"en.{f}").alias("en"), F.col(f"ar.{f}").alias("ar"))
    answer = F.struct(F.col("en.answers")[0]["text"].alias("en"), F.col("ar.answers")[0]["text"].alias("ar"))
    questions = pairs.select(
        qid.alias("qid"), F.lit(source).alias("source"), F.lit("single").alias("kind"), F.lit("en->ar").alias("direction"), F.lit("human").alias("translation"), text("question").alias("question"), answer.alias("answer"),
        F.array(chunk).alias("gold_chunks"), F.array(F.array(chunk)).alias("relevant_groups"),
    )
    return passages, questions
