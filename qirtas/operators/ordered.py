"""Neighbouring rows of long ordered groups, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import materialize

BUCKET = 4096


def neighbour(df: DataFrame, keys: list[str], order: str, value: str, out: str, ahead: bool = True, ties: tuple[str, ...] = (), bucket: int = BUCKET) -> DataFrame:
    """`df` with `out`: the value of the next (or, with ahead=False, the previous) row of its group; NULL at the end.

    Rows are ordered by the whole number `order`, then by `ties`, in buckets of `bucket` numbers; what stands beyond
    a bucket's rim is looked up in the buckets' first (last) values, of which there are `bucket` times fewer.
    """
    own = df.withColumn("_b", F.floor(F.col(order) / bucket).cast("bigint"))
    rim = F.struct(F.col(order).alias("o"), *(F.col(t).alias(f"t{i}") for i, t in enumerate(ties)), F.col(value).alias("v"))
    edge = own.groupBy(*keys, "_b").agg((F.min(rim) if ahead else F.max(rim)).alias("_r"))
    w = W.partitionBy(*keys).orderBy(F.col("_b") if ahead else F.col("_b").desc())
    beyond = edge.withColumn("_far", F.lead("_r").over(w)).select(*keys, "_b", "_far")
    near = W.partitionBy(*keys, "_b").orderBy(*(F.col(c) if ahead else F.col(c).desc() for c in (order, *ties)))
    marked = own.withColumns({"_n": F.lead(value).over(near), "_more": F.lead(F.lit(1)).over(near)})
    joined = marked.join(beyond, [*keys, "_b"], "left")
    return joined.withColumn(out, F.when(F.col("_more").isNotNull(), F.col("_n")).otherwise(F.col("_far.v"))).drop("_b", "_n", "_more", "_far")


def highest_before(df: DataFrame, keys: list[str], order: str, value: str, out: str, ties: tuple[str, ...] = (), bucket: int = BUCKET) -> DataFrame:
    """`df` with `out`: the largest value of all rows of the group before a row; NULL for the first.  NULL values are passed over.

    In buckets of `bucket` numbers of `order`, like `neighbour`: what stands before a bucket is its predecessors' largest value.
    """
    own = df.withColumn("_b", F.floor(F.col(order) / bucket).cast("bigint"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    edge = own.groupBy(*keys, "_b").agg(F.max(value).alias("_m")).withColumn("_far", F.max("_m").over(before)).drop("_m")
    near = W.partitionBy(*keys, "_b").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    joined = own.withColumn("_near", F.max(value).over(near)).join(edge, [*keys, "_b"], "left")
    return joined.withColumn(out, F.greatest("_near", "_far")).drop("_b", "_near", "_far")


def numbered(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """`df` with `out`: the place of each row in its group by `order`, from 0; equal values are in any order.

    Rows are dealt out in ranges of (keys, order) and written, so that ranges stay as they are; a range is numbered in a
    task of its own, after the counts of the group's ranges before it.
    """
    ranged = materialize(df.repartitionByRange(*keys, order).withColumn("_r", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_r").agg(F.count("*").alias("_n"))  # a row for each range of a group
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(*keys).orderBy("_r")) - F.col("_n")).drop("_n")
    at = F.row_number().over(W.partitionBy(*keys, "_r").orderBy(order))
    return ranged.withColumn("_at", at).join(before, [*keys, "_r"]).withColumn(out, F.col("_before") + F.col("_at") - 1).drop("_r", "_at", "_before")
