"""The configuration grammar: a name becomes one lazy plan.

bm25-ANALYZER, dense names, hybrid:A+B, rerank:NAME; hybrids and reranks name other configurations, so they nest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dense, fusion, retrieval

# The order in which configurations are reported.
LADDER = ("bm25-raw", "bm25-norm", "bm25-light", "e5-base", "bge-m3", "hybrid:bm25-light+e5-base", "hybrid:bm25-light+bge-m3", "rerank:hybrid:bm25-light+bge-m3")
DEPTH = 100
# The question file each corpus is evaluated with; the uncorrected corpus has the same questions.
QUESTION_FILES = {"xquad": "xquad.jsonl", "unpc": "unpc_pilot.jsonl", "unpc_uncorrected": "unpc_pilot.jsonl"}


def questions_of(corpus: str) -> str:
    """The question file of a corpus; an unknown corpus fails."""
    if corpus not in QUESTION_FILES:
        raise ValueError(f"no corpus {corpus!r}; there are {', '.join(sorted(QUESTION_FILES))}")
    return QUESTION_FILES[corpus]


@dataclass
class Corpus:
    """docs (doc, text) and queries (qid, text) per language, and vectors (doc/qid, vector) per dense name and language."""

    docs: dict[str, DataFrame]
    queries: dict[str, DataFrame]
    doc_vectors: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    query_vectors: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    scorer: Callable[[Column, Column], Column] | None = None


def parse(name: str) -> tuple[str, list[str]]:
    """(kind, arguments) of a configuration; an unknown one fails."""
    kind, colon, rest = name.partition(":")
    if colon and kind == "hybrid":
        parts = rest.split("+")
        if len(parts) < 2 or not all(parts):
            raise ValueError(f"a hybrid needs two parts: {name!r}")
        return "hybrid", parts
    if colon and kind == "rerank":
        if not rest:
            raise ValueError(f"nothing to rerank: {name!r}")
        return "rerank", [rest]
    if not colon and name.startswith("bm25-") and name[5:] in retrieval.ANALYZERS:
        return "bm25", [name[5:]]
    if not colon and name and not name.startswith("bm25"):
        return "dense", [name]
    raise ValueError(f"no configuration {name!r}")


def plan(name: str, corpus: Corpus, query_lang: str, doc_lang: str, depth: int = DEPTH) -> DataFrame:
    """(qid, doc, score, rank) of a configuration for a pair of languages; only dense ones cross languages."""
    kind, args = parse(name)
    if kind != "dense" and query_lang != doc_lang:
        raise ValueError(f"{name} does not cross languages")
    if kind == "bm25":
        docs = retrieval.analyze(corpus.docs[doc_lang], args[0], doc_lang)
        queries = retrieval.analyze(corpus.queries[query_lang], args[0], query_lang)
        return retrieval.bm25(docs, queries, depth)
    if kind == "dense":
        if (args[0], doc_lang) not in corpus.doc_vectors:
            raise ValueError(f"no vectors of {args[0]!r}")
        return dense.exact_search(corpus.doc_vectors[args[0], doc_lang], corpus.query_vectors[args[0], query_lang], depth)
    if kind == "hybrid":
        return fusion.rrf([plan(a, corpus, query_lang, doc_lang, depth) for a in args], depth)
    scorer = corpus.scorer or (lambda q, t: T.token_f1(T.words(F.lower(q)), T.words(F.lower(t))))
    inner = plan(args[0], corpus, query_lang, doc_lang, depth)
    return fusion.rerank(inner, corpus.queries[query_lang].select("qid", F.col("text").alias("query")), corpus.docs[doc_lang], scorer, depth)


def ladder(results: DataFrame, order: tuple[str, ...] = LADDER) -> DataFrame:
    """(place, config, en, ar, gap) of results (config, pair, value) in the order of the report; unlisted configurations are left out."""
    place = F.create_map(*(F.lit(x) for i, name in enumerate(order) for x in (name, i)))
    wide = results.withColumn("place", F.element_at(place, F.col("config"))).filter("place IS NOT NULL").groupBy("place", "config").agg(
        F.max(F.when(F.col("pair") == "en-en", F.col("value"))).alias("en"), F.max(F.when(F.col("pair") == "ar-ar", F.col("value"))).alias("ar")
    )
    return wide.select("place", "config", "en", "ar", F.round(F.col("en") - F.col("ar"), 6).alias("gap"))


def markdown(rows: list[dict], columns: list[str], digits: int = 3) -> str:
    """A small result as a table; numbers to `digits` decimals, NULL as a dash."""

    def cell(v) -> str:
        return "–" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)

    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows)])
