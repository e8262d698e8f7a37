"""Exact similarity join on word shingles, by prefix filtering.

Shingles are ordered from rare to common.  Two sets of similarity t or more share a shingle among the first
n - ceil(t * n) + 1 of each, so only these prefixes are joined; common shingles, which are in thousands of texts, are
never paired.  Candidates of too different sizes are dropped, the rest is counted exactly.  Shingles so common that
their rows would crowd one task get their counts by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import materialize, small_or_not

SIZE, THRESHOLD = 5, 0.8
#: Shingles of more texts than this are few; they are told apart before counts are joined.
CROWD = 100_000


def shingles(tokens: Column, size: int = SIZE) -> Column:
    """Distinct runs of `size` tokens; a shorter text is one shingle, an empty one has none."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, size), " "))
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def similar(docs: DataFrame, queries: DataFrame, threshold: float = THRESHOLD, size: int = SIZE, crowd_size: int = CROWD) -> DataFrame:
    """(query, doc, similarity >= threshold), doc <> query, of texts (doc, tokens) with the texts (doc, tokens) of the query set.

    Texts without tokens are like nothing.  Of a repeated doc, the caller keeps one row.
    """
    sets = docs.select("doc", F.transform(shingles(F.col("tokens"), size), lambda s: F.xxhash64(s)).alias("s")).filter(F.size("s") > 0)
    sets = materialize(sets)
    single = sets.select("doc", F.size("s").alias("n"), F.explode("s").alias("h"))
    counts = materialize(single.groupBy("h").agg(F.count("*").alias("df")))
    crowd = materialize(counts.filter(F.col("df") > crowd_size))
    if crowd.isEmpty():
        counted = single.join(counts, "h")
    else:
        crowd = small_or_not(crowd)
        counted = single.join(crowd, "h", "left_anti").join(counts.filter(F.col("df") <= crowd_size), "h").unionByName(single.join(crowd, "h"))
    ordered = counted.withColumn("at", F.row_number().over(W.partitionBy("doc").orderBy("df", "h")))
    prefix = ordered.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("doc", "n", "h")
    asked = queries.select("doc").distinct()
    left = prefix.join(asked, "doc", "left_semi").select(F.col("doc").alias("query"), F.col("n").alias("m"), "h")
    fits = (F.col("n") >= threshold * F.col("m") - 1e-9) & (F.col("m") >= threshold * F.col("n") - 1e-9)
    pairs = left.join(prefix, "h").filter((F.col("doc") != F.col("query")) & fits).select("query", "doc").distinct()
    both = pairs.join(sets.select(F.col("doc").alias("query"), F.col("s").alias("a")), "query").join(sets.select("doc", F.col("s").alias("b")), "doc")
    shared = F.size(F.array_intersect("a", "b"))
    return both.select("query", "doc", (shared / (F.size("a") + F.size("b") - shared)).alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)


def relevance_groups(gold: DataFrame, links: DataFrame) -> DataFrame:
    """(gold, member, place): each gold id first, then what is similar to it, in order of ids."""
    own = gold.select(F.col("doc").alias("gold"), F.col("doc").alias("member")).distinct()
    both = own.unionByName(links.select(F.col("query").alias("gold"), F.col("doc").alias("member")))
    w = W.partitionBy("gold").orderBy((F.col("member") != F.col("gold")), "member")
    return both.withColumn("place", F.row_number().over(w))
