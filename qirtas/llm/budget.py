"""Token counts of texts and their totals by slice (problem 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import materialize, spread
from . import bpe, flat

#: So many of the most frequent pieces are looked up where the text is; the rest is joined.  A few MB.
HOT_PIECES = 100_000
#: A task adds up the counts of at most this many pieces before it passes them on.
TASK_PIECES = 200_000


def count_pieces(texts: DataFrame, tokenizer: str = bpe.DEFAULT, folder: str | None = None) -> DataFrame:
    """(piece, n) over the column `text`: how often each pre-split piece stands in all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(bpe.load(tokenizer, folder))

    def run(batches):
        encoder, total = bpe.Encoder(shared.value), {}

        def passed_on():
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["piece", "n"])

        for batch in batches:
            text = flat.strings(batch.column(0))
            for a, b in flat.slices(text):
                words, kind, _ = encoder.split(text.slice(a, b - a))
                for word, n in zip(words, np.bincount(kind, minlength=len(words)).tolist(), strict=True):
                    total[word] = total.get(word, 0) + n
                if len(total) > TASK_PIECES:
                    yield passed_on()
                    total.clear()
        yield passed_on()

    return texts.select("text").mapInArrow(run, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def piece_lengths(counted: DataFrame, tokenizer: str = bpe.DEFAULT, folder: str | None = None) -> DataFrame:
    """(piece, n, n_tokens): each distinct piece is tokenized once."""
    shared = counted.sparkSession.sparkContext.broadcast(bpe.load(tokenizer, folder))

    def run(batches):
        for batch in batches:
            words = [w.encode("utf-8") for w in batch.column(0).to_pylist()]
            sizes = np.diff(bpe.merge(words, shared.value)[1]) if words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["piece", "n", "n_tokens"])

    return counted.select("piece", "n").mapInArrow(run, "piece string, n bigint, n_tokens bigint")


def token_counts(texts: DataFrame, keys: list[str], tokenizer: str = bpe.DEFAULT, folder: str | None = None, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """(keys, n_tokens) of each row of `texts` (the keys and a column `text`).

    NULL and empty texts have 0 tokens.  Keys may be NULL; rows that repeat all keys and the text count once; rows
    that share their keys but not their texts keep a row each.  An empty table gives an empty result.

    Distinct pieces are tokenized once.  The most frequent `hot_pieces` of them (a bound in bytes) are looked up
    in place; frequencies of the others are joined with their lengths, so totals are exact whatever the bound.
    """
    spark = texts.sparkSession
    texts = spread(texts.select(*keys, F.col("text").cast("string").alias("text")))
    lengths = materialize(piece_lengths(count_pieces(texts, tokenizer, folder), tokenizer, folder))
    top = lengths.orderBy(F.desc("n"), "piece").limit(hot_pieces).select("piece", "n_tokens").toArrow()
    hot = spark.sparkContext.broadcast(dict(zip(top["piece"].to_pylist(), top["n_tokens"].to_pylist(), strict=True)))
    shared = spark.sparkContext.broadcast(bpe.load(tokenizer, folder))
    n_keys = len(keys)

    def run(batches):
        encoder, known = bpe.Encoder(shared.value), hot.value
        for batch in batches:
            text = flat.strings(batch.column(n_keys))
            warm, cold_at, cold_piece, cold_n = [], [], [], []
            for a, b in flat.slices(text):
                words, kind, before = encoder.split(text.slice(a, b - a))
                size = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))[kind]
                total = np.concatenate(([0], np.cumsum(np.maximum(size, 0))))
                warm.append(np.diff(total[before]))
                odd = np.flatnonzero(size < 0)
                row = np.searchsorted(before, odd, side="right") - 1
                pair, n = np.unique(row * max(1, len(words)) + kind[odd], return_counts=True)
                cold_at.append(a + pair // max(1, len(words)))
                cold_piece.extend(words[i] for i in (pair % max(1, len(words))).tolist())
                cold_n.append(n)
            rows = np.concatenate(cold_at) if cold_at else np.zeros(0, np.int64)
            offsets = pa.array(np.searchsorted(rows, np.arange(len(text) + 1)).astype(np.int32))
            cold = pa.StructArray.from_arrays([pa.array(cold_piece, pa.string()), pa.array(np.concatenate(cold_n) if cold_n else [], pa.int64())], ["piece", "times"])
            found = pa.array(np.concatenate(warm) if warm else [], pa.int64())
            # the text's hash tells rows with the same keys apart
            mark = pa.array([hash_of(x) for x in text.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], mark, found, pa.ListArray.from_arrays(offsets, cold)], [*keys, "mark", "found", "cold"])

    schema = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    by_text = materialize(texts.mapInArrow(run, f"{schema}, mark bigint, found bigint, cold array<struct<piece: string, times: bigint>>").dropDuplicates([*keys, "mark"]))
    done = by_text.filter(F.size("cold") == 0).select(*keys, F.col("found").alias("n_tokens"))
    rest = by_text.filter(F.size("cold") > 0).select(*keys, "mark", "found", F.explode("cold").alias("c")).select(*keys, "mark", "found", "c.piece", "c.times")
    rest = rest.join(lengths.select("piece", F.col("n_tokens").alias("each")), "piece").groupBy(*keys, "mark", "found").agg(F.sum(F.col("times") * F.col("each")).alias("more"))
    return done.unionByName(rest.select(*keys, (F.col("found") + F.col("more")).alias("n_tokens")))


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def language(lang: Column) -> Column:
    """One spelling of the language labels met in the tables; NULL and blank become 'unknown'."""
    word = F.lower(F.trim(F.coalesce(lang, F.lit(""))))
    word = F.substring_index(F.substring_index(word, "-", 1), "_", 1)
    return F.when(word.isin("eng", "en"), "en").when(word.isin("ara", "ar"), "ar").when(word.isin("fra", "fre", "fr"), "fr").when(word == "", "unknown").otherwise(word)


def corpus_texts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The texts whose tokens count: both languages of each chunk, and each document."""
    sides = [
        chunks.select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("record_id"), F.lit(side).alias("language"), "source", "domain", F.col(side).alias("text"))
        for side in ("en", "ar")
    ]
    whole = documents.select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("record_id"), language(F.col("lang")).alias("language"), "source", "domain", "text")
    return sides[0].unionByName(sides[1]).unionByName(whole)


KEYS = ["tbl", "record_id", "language", "source", "domain"]


def slice_totals(counts: DataFrame) -> DataFrame:
    """Texts and tokens of each table, source, language and domain (a NULL source or domain is a slice of its own)."""
    return counts.groupBy("tbl", "source", "language", "domain").agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"))


def slice_ratios(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """Arabic-to-English token ratio of each chunk slice beside the published one of its newest build.

    A chunk counts if both sides have tokens.  The median is over the chunks' ratios to four decimals (as
    published), counted before they meet, so a slice of any size takes bounded memory.  Slices that only one side
    knows have NULL for the other; of builds of the same time the larger ratio counts.
    """
    sides = counts.filter(F.col("tbl") == "chunks").groupBy("record_id", "source", "domain").agg(
        F.sum(F.when(F.col("language") == "en", F.col("n_tokens"))).alias("en"), F.sum(F.when(F.col("language") == "ar", F.col("n_tokens"))).alias("ar")
    )
    ratio = sides.filter("en > 0 AND ar > 0").withColumn("ratio", F.round(F.col("ar") / F.col("en"), 4))
    by_value = ratio.groupBy("source", "domain", "ratio").agg(F.count("*").alias("times"), F.sum("en").alias("en"), F.sum("ar").alias("ar"))
    ours = by_value.groupBy("source", "domain").agg(
        F.sum("times").alias("n_chunks"), F.round(F.expr("percentile(ratio, 0.5, times)"), 4).alias("median_ratio"), F.round(F.sum("ar") / F.sum("en"), 4).alias("total_ratio")
    )
    newest = stats.groupBy(F.col("source").alias("s"), F.col("domain").alias("d")).agg(F.max(F.struct("built_at", F.col("ar_to_en_token_ratio.median").alias("m"))).alias("b"))
    both = ours.join(newest, ours.source.eqNullSafe(newest.s) & ours.domain.eqNullSafe(newest.d), "full_outer")
    return both.select(F.coalesce("source", "s").alias("source"), F.coalesce("domain", "d").alias("domain"), "n_chunks", "median_ratio", "total_ratio", F.col("b.m").alias("published_median"))
