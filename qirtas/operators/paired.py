"""Paired comparisons: bootstrap intervals and McNemar's exact test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered

RESAMPLES, ALPHA = 10_000, 0.05
#: So many draws are held at once.
DRAWS = 1_000_000


def mcnemar_p(only_a: Column, only_b: Column) -> Column:
    """Two-sided exact p of discordant counts; 1 if there are none.

    Binomial terms are summed from logarithms, each from the one before, so that any number of pairs works.
    """
    n, least = (only_a + only_b).cast("double"), F.least(only_a, only_b).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))

    def add(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i)
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    steps = F.when(least >= 1, F.sequence(F.lit(1), F.greatest(least, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.least(F.lit(1.0), 2 * F.aggregate(steps, start, add, lambda z: z["s"]))


def mcnemar(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """n, only_a, only_b and p per `by` of pairs with two boolean outcomes; a NULL outcome counts as false."""
    x, y = F.coalesce(F.col(a), F.lit(False)), F.coalesce(F.col(b), F.lit(False))
    counts = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(x & ~y).alias("only_a"), F.count_if(y & ~x).alias("only_b"))
    return counts.withColumn("p", mcnemar_p(F.col("only_a"), F.col("only_b")))


def bootstrap(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """(by, n, mean, low, high): mean difference and its percentile interval over resampled questions.

    Draws come from numpy's PCG64 with `seed`, over the pairs in order of their `qid`.  One stream of draws runs over a
    whole group, so a group's two columns of numbers are gathered in one task: a configuration's questions, not its
    documents.  Draws are made `DRAWS` at a time.  For any number of pairs there is `hash_bootstrap`.  A NULL in a pair fails.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("qid", kind="stable")
        d = (frame[a] - frame[b]).to_numpy(float)
        if np.isnan(d).any():
            raise ValueError("a pair lacks one of its scores")
        rng = np.random.default_rng(seed)
        step = max(1, DRAWS // len(d))
        means = np.concatenate([d[rng.integers(0, len(d), (min(step, resamples - i), len(d)))].mean(axis=1) for i in range(0, resamples, step)])
        low, high = np.quantile(means, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame([[*(frame[c].iloc[0] for c in by), len(d), d.mean(), low, high]], columns=[*by, "n", "mean", "low", "high"])

    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by)
    return pairs.select(*by, "qid", a, b).groupBy(*by).applyInPandas(run, f"{schema}, n bigint, mean double, low double, high double")


def hash_bootstrap(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", resamples: int = 200, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """The same interval with draws by hash, in joins and aggregates alone: any engine can recompute it, on any number of pairs.

    Draw i of resample r is row number sha256(seed|r|i) modulo n.  Rows are numbered within `by` in order of qid.
    """
    rows = numbered(pairs.select(*by, "qid", (F.col(a) - F.col(b)).alias("d")), by, "qid", "i").select(*by, "d", "i")
    size = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    draws = rows.join(size, by).select(*by, "n", "i", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("r"))
    place = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("r"), F.col("i")), 256), 1, 8), 16, 10).cast("bigint"), F.col("n"))
    drawn = draws.select(*by, "r", place.alias("i")).join(rows.select(*by, "i", "d"), [*by, "i"])
    means = drawn.groupBy(*by, "r").agg(F.avg("d").alias("m"))
    ends = means.groupBy(*by).agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))
    return size.join(ends, by).select(*by, "n", "mean", "low", "high")


def paired_report(scores: DataFrame, by: list[str], pair: str, a: str, b: str, metrics: list[str]) -> DataFrame:
    """Long pairs (by, metric, qid, a, b) of the questions that both sides of column `pair` scored."""
    long = scores.filter(F.col(pair).isin(a, b)).unpivot([*by, pair, "qid"], metrics, "metric", "value")
    return long.groupBy(*by, "metric", "qid").agg(F.max(F.when(F.col(pair) == a, F.col("value"))).alias("a"), F.max(F.when(F.col(pair) == b, F.col("value"))).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
