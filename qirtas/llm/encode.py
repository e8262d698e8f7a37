"""Encoding a corpus with a public tokenizer (problem 7)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.lineage import spread
from . import bpe, flat


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = bpe.DEFAULT, folder: str | None = None) -> DataFrame:
    """(key, ids) of each row: the ids of the whole text by the tokenizer, without special tokens.

    NULL and empty texts give an empty list; white space is text like any other.  A NULL key is kept; repeated
    rows give repeated results; an empty table gives an empty result.  Other columns of `df` are not read.
    The vocabulary (about 1 MB, a fixed size) is read on the driver and broadcast.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(bpe.load(tokenizer, folder))
    narrow = spread(df.select(df[key].alias("key"), df[text].cast("string").alias("text")))

    def run(batches):
        encoder = bpe.Encoder(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder.encode(flat.strings(batch.column(1)))], ["key", "ids"])

    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
