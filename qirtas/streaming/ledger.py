"""The usage ledger as a stream: what was appended since the last run is added up once, and a restart goes on there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ENTRY = "ts timestamp, model string, key string, prompt_tokens bigint, completion_tokens bigint"


def read_ledger(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def usage_by_window(entries: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, model, calls, prompt_tokens, completion_tokens) per window; entries later than `late` are left out, a key counts once."""
    once = entries.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])
    w = once.groupBy(F.window("ts", width), "model").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return w.select(F.col("window.start").alias("start"), "model", "calls", "prompt_tokens", "completion_tokens")


def run_available(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now to `target` and stop; batches are written under their number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
