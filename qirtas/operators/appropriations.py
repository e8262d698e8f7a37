"""What missions got for which period: from paragraphs of financing resolutions to records, and what can be compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import financing
from ..functions import text as T

# The path of resolutions, how many first sentences may hold the title, and how many pairs make comparisons worth while.
RESOLUTION_PATH, TITLE_SENTENCES, GATE = r"^\d{4}/a/res/", 40, 60


def is_resolution(doc_id: Column) -> Column:
    """Whether a document is filed as a resolution; NULL is none."""
    return F.coalesce(doc_id.rlike(RESOLUTION_PATH), F.lit(False))


def financing_documents(sentences: DataFrame, first: int = TITLE_SENTENCES) -> DataFrame:
    """(doc_id) of the documents (doc_id, pos, text) with a financing title among their first sentences (pos counts from 1)."""
    return sentences.filter((F.col("pos") <= first) & F.coalesce(F.col("text").rlike(financing.TITLE), F.lit(False))).select("doc_id").distinct()


def records(english: DataFrame, arabic: DataFrame) -> DataFrame:
    """(doc_id, first, status, mission, period, amount, amount_text) of the paragraphs that appropriate.

    english and arabic are paragraphs (doc_id, first, text), `first` their place.  status is 'usable', or the first that
    holds of: the kind where it is no whole appropriation; no_mission_name (neither the paragraph nor the document names
    one); arabic_amount_not_found.  Paragraphs that appropriate nothing, and NULL texts, give no rows; repeated rows
    count once.
    """
    own = english.select("doc_id", "first", "text").distinct()
    found = own.withColumn("x", financing.appropriation(F.col("text"))).filter("x IS NOT NULL")
    named = found.join(financing.document_missions(own, "doc_id").withColumnRenamed("mission", "document_mission"), "doc_id", "left")
    named = named.select("doc_id", "first", "x.kind", "x.period", "x.amount", "x.amount_text", F.coalesce("x.mission", "document_mission").alias("name"))
    normal = arabic.select("doc_id", T.normalized(F.col("text"), "ar").alias("normal")).filter(F.contains(F.col("normal"), F.lit(financing.AMOUNT_WORD)))
    told = named.select("doc_id", "amount_text").distinct().join(normal, "doc_id").filter(financing.confirms(F.col("normal"), F.col("amount_text")))
    there = told.select("doc_id", "amount_text").distinct().withColumn("told", F.lit(True))
    status = F.when(F.col("kind") != financing.WHOLE, F.col("kind")).when(F.col("name").isNull(), "no_mission_name").when(F.col("told").isNull(), "arabic_amount_not_found").otherwise("usable")
    return named.join(there, ["doc_id", "amount_text"], "left").select("doc_id", "first", status.alias("status"), financing.canonical_mission(F.col("name")).alias("mission"), "period", "amount", "amount_text")


def first_of_period(found: DataFrame) -> DataFrame:
    """(mission, period, doc_id, amount, n_repeats): of the usable records of a mission and period the one that comes first, and how many more there are."""
    usable = found.filter("status = 'usable'")
    first = usable.groupBy("mission", "period").agg(F.min_by(F.struct("doc_id", "amount"), F.struct("doc_id", "first")).alias("r"), (F.count("*") - 1).alias("n_repeats"))
    return first.select("mission", "period", "r.doc_id", "r.amount", "n_repeats")


def by_period(firsts: DataFrame) -> DataFrame:
    """(period, n_missions, disjoint_pairs, all_pairs): how many missions a period has, and how many comparisons they make."""
    n = firsts.groupBy("period").agg(F.countDistinct("mission").alias("n_missions"))
    return n.select("period", "n_missions", F.floor(F.col("n_missions") / 2).alias("disjoint_pairs"), F.floor(F.col("n_missions") * (F.col("n_missions") - 1) / 2).alias("all_pairs"))


def missions_per_period(periods: DataFrame) -> DataFrame:
    """(n_missions, n_periods): how many periods have so many missions."""
    return periods.groupBy("n_missions").agg(F.count("*").alias("n_periods"))


def verdict(firsts: DataFrame, gate: int = GATE) -> DataFrame:
    """One row: n_missions, n_periods, disjoint_pairs, all_pairs, and whether the disjoint pairs are enough."""
    sums = by_period(firsts).agg(F.count("*").alias("n_periods"), F.coalesce(F.sum("disjoint_pairs"), F.lit(0)).alias("disjoint_pairs"), F.coalesce(F.sum("all_pairs"), F.lit(0)).alias("all_pairs"))
    missions = firsts.agg(F.countDistinct("mission").alias("n_missions"))
    return missions.crossJoin(sums).withColumn("enough", F.col("disjoint_pairs") >= gate)  # one row each
