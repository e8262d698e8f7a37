"""Rank fusion and shortlist reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import top_k

RRF_K, DEPTH, SHORTLIST = 60, 100, 50


def rrf(runs: list[DataFrame], k: int, depth: int = DEPTH, constant: int = RRF_K) -> DataFrame:
    """(qid, doc, score, rank): reciprocal rank fusion of runs (qid, doc, rank), each cut at `depth`; ties go to the smaller doc.

    A document that a run lacks gets nothing from it; one that stands twice in a run counts twice.
    """
    parts = [r.filter(F.col("rank") <= depth).select("qid", "doc", (1 / (F.lit(constant) + F.col("rank"))).alias("s")) for r in runs]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return top_k(union.groupBy("qid", "doc").agg(F.sum("s").alias("score")), k)


def rerank(run: DataFrame, queries: DataFrame, docs: DataFrame, scorer: Callable[[Column, Column], Column], k: int, shortlist: int = SHORTLIST) -> DataFrame:
    """(qid, doc, score, rank): the first `shortlist` of each ranking, scored anew from (query, text) and cut at k.

    queries (qid, query) and docs (doc, text) hold what the scorer reads; the cut comes before anything is scored.
    """
    pairs = run.filter(F.col("rank") <= shortlist).select("qid", "doc").join(queries.select("qid", "query"), "qid").join(docs.select("doc", "text"), "doc")
    return top_k(pairs.select("qid", "doc", scorer(F.col("query"), F.col("text")).alias("score")), k)


def f1_scorer(query_tokens: Column, doc_tokens: Column) -> Column:
    """Deterministic stand-in for a cross-encoder: F1 of the tokens."""
    return T.token_f1(query_tokens, doc_tokens)
