"""Metrics of rankings against relevance groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 5, 10, 20)
CUT = 10


def judgements(questions: DataFrame) -> DataFrame:
    """(qid, grp, doc) of questions (qid, relevant_groups): one row per member; NULL lists and members are left out.

    Groups count from 0 by their place; a group without members is no group.
    """
    groups = questions.select("qid", F.posexplode("relevant_groups").alias("grp", "members"))
    return groups.select("qid", "grp", F.explode("members").alias("doc")).filter("doc IS NOT NULL").distinct()


def first_hits(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, grp, hit) for every group: the rank of its first member in the run (qid, doc, rank), NULL if none is there."""
    return qrels.join(run.select("qid", "doc", "rank"), ["qid", "doc"], "left").groupBy("qid", "grp").agg(F.min("rank").alias("hit"))


def _within(k: int) -> Column:
    return F.coalesce(F.col("hit") <= k, F.lit(False))


def question_metrics(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS, cut: int = CUT) -> DataFrame:
    """recall, all_recall at each k, MRR and nDCG at `cut` of each question with a relevance group.

    Duplicates within a group are credited once.  A question whose run is empty scores 0; that it was run at all is for
    `missing_questions` to say.
    """
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.count("*"), F.lit(cut)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    gain = F.sum(F.when(_within(cut), 1 / F.log2(F.col("hit") + 1.0)).otherwise(0.0))
    return first_hits(run, qrels).groupBy("qid").agg(
        *(F.avg(_within(k).cast("double")).alias(f"recall_{k}") for k in ks),
        *(F.bool_and(_within(k)).cast("double").alias(f"all_recall_{k}") for k in ks),
        F.coalesce(1 / F.min(F.when(_within(cut), F.col("hit"))), F.lit(0.0)).alias(f"mrr_{cut}"),
        (gain / ideal).alias(f"ndcg_{cut}"),
    )


def mean_metrics(per_question: DataFrame, by: list[str]) -> DataFrame:
    """Number of questions and the mean of each metric, per configuration and whatever else is in `by`."""
    names = [c for c in per_question.columns if c.split("_")[0] in ("recall", "all", "mrr", "ndcg")]
    return per_question.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in names))


def missing_questions(questions: DataFrame, runs: DataFrame) -> DataFrame:
    """The questions (qid) that a run (qid) lacks; a complete run gives no rows."""
    return questions.select("qid").distinct().join(runs.select("qid").distinct(), "qid", "left_anti")
