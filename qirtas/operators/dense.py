"""Exact vector search and encoding hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .retrieval import top_k

#: Query vectors are broadcast in blocks of so many numbers (8 bytes each).
BLOCK_NUMBERS = 4_000_000

# What models want before a text.
PREFIXES = {"e5": ("query: ", "passage: "), "bge": ("", "")}


def exact_search(vectors: DataFrame, queries: DataFrame, k: int, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """(qid, doc, score, rank) of the k largest inner products of queries (qid, vector) with vectors (doc, vector).

    NULL vectors take no part; k beyond the number of vectors gives all; ties go to the smaller doc.  Vectors of another
    length than the queries' fail the query.  The queries are the stated set: they go out in blocks of bounded size, one
    matrix product per batch of vectors, and each batch keeps its own k best before anything is shuffled.
    """
    asked = queries.filter("vector IS NOT NULL").select("qid", "vector").orderBy("qid")
    first = asked.select(F.size("vector")).first()
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, doc {vectors.schema['doc'].dataType.simpleString()}, score double"
    if first is None:
        return top_k(vectors.sparkSession.createDataFrame([], kinds), k)
    spark, per_block = vectors.sparkSession, max(1, block_numbers // max(1, first[0]))
    blocks = -(-asked.count() // per_block)
    out = None
    for i in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        rows = part.toArrow()  # about per_block rows
        if not rows.num_rows:
            continue
        shared = spark.sparkContext.broadcast((rows["qid"].combine_chunks(), np.array(rows["vector"].to_pylist(), np.float64)))

        def run(batches, shared=shared):
            names, matrix = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors, docs = batch.column(1), batch.column(0)
                numbers = vectors.flatten()
                if len(numbers) != len(vectors) * matrix.shape[1] or numbers.null_count or (vectors.value_lengths().to_numpy() != matrix.shape[1]).any():
                    raise ValueError("a vector is of another length than the queries', or lacks a number")
                score = numbers.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1) @ matrix.T
                rounded = np.round(score, 9)
                last = np.partition(rounded, -min(k, len(vectors)), axis=0)[-min(k, len(vectors))]
                # with ties at the last place, all of them: the smaller doc is chosen among all batches
                row, q = np.nonzero(rounded >= last)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), docs.take(pa.array(row)), pa.array(score[row, q])], ["qid", "doc", "score"])

        found = vectors.filter("vector IS NOT NULL").select("doc", "vector").mapInArrow(run, kinds)
        out = found if out is None else out.unionByName(found)
    return top_k(out, k)


def inner_product(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision, as a built-in expression (for few pairs)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def encode(texts: DataFrame, encoder: Callable[[list[str]], Iterable[list[float]]], text: str = "text", prefix: str = "", batch: int = 32) -> DataFrame:
    """`texts` with a column vector: the encoder's vectors of prefix + text, scaled to length 1 (a zero vector stays).

    The encoder is called once for each distinct text of a batch, with `batch` texts at a time.
    """

    def run(frames):
        for frame in frames:
            distinct = frame[text].dropna().drop_duplicates().tolist()
            known: dict[str, list[float]] = {}
            for a in range(0, len(distinct), batch):
                some = distinct[a : a + batch]
                for t, v in zip(some, encoder([prefix + t for t in some]), strict=True):
                    v = np.asarray(v, np.float32)
                    size = float(np.linalg.norm(v))
                    known[t] = (v / size if size else v).tolist()
            yield frame.assign(vector=[known.get(t) if isinstance(t, str) else None for t in frame[text]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInPandas(run, f"{schema}, vector array<float>")


def fingerprint(texts: DataFrame, order: str, text: str = "text", model: str = "", prefix: str = "") -> DataFrame:
    """One row, key: 16 hex digits that identify a model, a prefix and texts in their order.

    The texts' own hashes are gathered, 64 characters each; they are hashed in ranges first, so none holds them all.
    """
    hashed = texts.select(F.col(order).alias("o"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h"))
    by_range = hashed.groupBy(F.floor(F.col("o") / 4096).alias("r")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    whole = by_range.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "h"))), lambda x: x["h"]), "").alias("all"))
    return whole.select(F.substring(F.sha2(F.concat(F.lit(f"{model}\x00{prefix}\x00"), F.col("all")), 256), 1, 16).alias("key"))


@F.pandas_udf(ArrayType(FloatType()))
def hashed_vector(texts: pd.Series) -> pd.Series:
    """Stand-in encoder for tests: words hashed to 64 places, scaled to length 1."""
    import zlib

    def one(t: str | None) -> list[float]:
        v = np.zeros(64, np.float32)
        for w in (t or "").lower().split():
            v[zlib.crc32(w.encode()) % 64] += 1
        size = float(np.linalg.norm(v))
        return (v / size if size else v).tolist()

    return texts.map(one)
