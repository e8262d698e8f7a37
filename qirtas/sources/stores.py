"""Stores between stages: rankings, vectors, model responses and their ledger."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def encode_name(config: str) -> str:
    """A configuration's name as a folder: ":" becomes "_", "+" becomes "__", "/" becomes "_"."""
    return config.replace("+", "__").replace(":", "_").replace("/", "_")


def write_run(run: DataFrame, root: str, corpus: str, config: str, pair: str) -> None:
    """Store a ranking (qid, doc, score, rank), scores to six decimals, as a partition of the table of rankings."""
    rows = run.select("qid", "doc", F.round("score", 6).alias("score"), "rank")
    rows.write.mode("overwrite").parquet(f"{root}/corpus={encode_name(corpus)}/config={encode_name(config)}/pair={pair}")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """All stored rankings; corpus, config and pair are columns that prune folders."""
    return spark.read.option("basePath", root).schema("qid string, doc string, score double, rank int, corpus string, config string, pair string").parquet(root)


def vectors_of(texts: DataFrame, root: str, key: str, encode: Callable[[DataFrame], DataFrame], id_column: str = "id") -> DataFrame:
    """(id, vector) of texts under the fingerprint `key`: read from the store, or made by `encode`, stored and read.

    A key stands for a model, a prefix and texts (`dense.fingerprint`), so other texts never meet old vectors.
    """
    spark = texts.sparkSession
    place = f"{root}/key={key}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        encode(texts).select(F.col(id_column).alias("id"), "vector").write.mode("overwrite").parquet(place)
    return spark.read.schema(f"id {texts.schema[id_column].dataType.simpleString()}, vector array<float>").parquet(place)


def request_key(endpoint: Column, model: Column, messages: Column, params: Column) -> Column:
    """Content address of a request: the hash of its JSON."""
    return F.sha2(F.to_json(F.struct(endpoint.alias("endpoint"), messages.alias("messages"), model.alias("model"), params.alias("params"))), 256)


def python_key(endpoint: str, model: str, messages: list[dict], params: dict) -> str:
    import hashlib

    return hashlib.sha256(json.dumps([endpoint, model, messages, params], sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def look_up(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (key) with their cached response, NULL where there is none; of several responses to a key the smallest."""
    one = cache.groupBy("key").agg(F.min("response").alias("response"))
    return requests.join(one, "key", "left")


def append(rows: DataFrame, path: str) -> None:
    """Append to a store of responses or to the ledger; what is there is never rewritten."""
    rows.write.mode("append").parquet(path)


class RateLimited(Exception):
    def __init__(self, wait: float | None = None, per_day: bool = False):
        super().__init__("per day" if per_day else f"wait {wait}")
        self.wait, self.per_day = wait, per_day


class ServerError(Exception):
    pass


class InvalidJson(Exception):
    pass


class DailyLimit(Exception):
    pass


def chat(key: str, call: Callable[[], dict], cache: dict[str, dict], ledger: list[dict], tries: int = 6, longest_wait: float = 120.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One request through the cache: its response, with `cached`.

    A hit costs nothing.  An answer that is no JSON is kept as empty, so that it is not asked for again.  A limit makes it
    wait, a limit for the day or a wait beyond `longest_wait` ends the run, server errors are tried again with growing
    waits, other errors pass through.  Each answer that was paid for is a line of the ledger.
    """
    if key in cache:
        return {**cache[key], "cached": True}
    for n in range(tries):
        try:
            answer = call()
        except InvalidJson:
            answer = {"text": "", "usage": {}}
        except RateLimited as limit:
            wait = 2.0**n if limit.wait is None else limit.wait
            if limit.per_day or wait > longest_wait:
                raise DailyLimit(str(limit)) from None
            sleep(wait)
            continue
        except ServerError:
            sleep(2.0**n)
            continue
        cache[key] = answer
        usage = answer.get("usage", {})
        ledger.append({"key": key, "prompt_tokens": usage.get("prompt_tokens", 0), "completion_tokens": usage.get("completion_tokens", 0)})
        return {**answer, "cached": False}
    raise ServerError("tried in vain")


def ask_all(requests: DataFrame, client: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """`requests` (key, prompt) with response: a session per partition, each distinct prompt of it asked once."""

    def run(frames):
        known: dict[str, str] = {}
        for frame in frames:
            for p in frame[prompt].dropna().unique():
                if p not in known:
                    known[p] = client(p)
            yield frame.assign(response=pd.Series([known.get(p) for p in frame[prompt]], index=frame.index, dtype=object))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.mapInPandas(run, f"{schema}, response string")
