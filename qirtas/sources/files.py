"""Line and table files: JSON lines, tab-separated tables, reports, audit exports, fingerprints."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.lineage import small_or_not

PAIRS = "doc_id string, doc_score double, n_links bigint, n_one_to_one bigint"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, fields: list[str] | None = None) -> DataFrame:
    """Records of a file or folder of JSON lines; with `fields`, only these are parsed.  Blank lines are skipped, a broken line fails."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.select(*fields) if fields else rows


def read_keyed(spark: SparkSession, path: str, schema: str | StructType, key: str, wanted: DataFrame) -> DataFrame:
    """The records whose key is in `wanted` (a table with that column)."""
    return read_jsonl(spark, path, schema).join(small_or_not(wanted.select(key).distinct()), key, "left_semi")


def _files(spark: SparkSession, path: str):
    """(file system, path) of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Frozen(Exception):
    """A table that must not be built again."""


def refuse_frozen(spark: SparkSession, path: str, frozen: bool = True) -> None:
    """Fail if what is to be written is frozen and already there."""
    system, at = _files(spark, path)
    if frozen and system.exists(at):
        raise Frozen(f"{path} is frozen; it is not built again")


def write_jsonl(df: DataFrame, path: str, frozen: bool = False) -> None:
    """Replace `path`: the new files are written beside it and take its place when they are whole; a frozen table stays."""
    spark = df.sparkSession
    refuse_frozen(spark, path, frozen)
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.json(beside)
    system, at = _files(spark, path)
    system.delete(at, True)
    if not system.rename(_files(spark, beside)[1], at):
        raise OSError(f"{beside} could not be moved to {path}")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The index of document pairs: tab-separated with a header, an empty score is NULL."""
    return spark.read.schema(PAIRS).option("sep", "\t").option("header", True).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_audit(samples: list[DataFrame], key: str, path: str, note: str = "note") -> None:
    """Union of samples as CSV with a byte-order mark for spreadsheets, each key once, the earlier sample first."""
    tagged = [s.withColumn("_from", F.lit(i)) for i, s in enumerate(samples)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    first = union.groupBy(key).agg(F.min_by(F.struct(*[c for c in union.columns if c not in (key, "_from")]), "_from").alias("r"), F.min("_from").alias("_from"))
    flat = first.select(key, "r.*", "_from").orderBy("_from", key).drop("_from")
    names = flat.columns
    head = flat.sparkSession.createDataFrame([("﻿" + ",".join(names),)], "value string")
    line = F.regexp_replace(F.to_csv(F.struct(*(F.col(c).cast("string").alias(c) for c in names))), "\n", " ")
    # the heading is its own first part; the order of parts is the order of the files
    head.unionByName(flat.select(line.alias("value"))).write.mode("overwrite").text(path)


def report(df: DataFrame, path: str, most: int = 10_000) -> None:
    """A small result as one JSON document on the driver's disk, replaced in one step; a larger result fails."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report is a small result")
    write_json([r.asDict(recursive=True) for r in rows], path)


def write_json(value: Any, path: str) -> None:
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1, default=str)
    os.replace(tmp, path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 that identifies the lines of a file, whatever their line ends.

    Line hashes are combined in ranges of the file's order, so that no task holds the file.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", r"\r+$", "").alias("v"), F.monotonically_increasing_id().alias("i"))
    hashed = lines.groupBy(F.floor(F.col("i") / 65536).alias("r")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.sha2("v", 256).alias("h")))), lambda x: x["h"]), ""), 256).alias("h"))
    whole = hashed.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return whole.first()[0]


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, read as they are."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def check_pinned(hashes: DataFrame, pinned: dict[str, str]) -> DataFrame:
    """The files of `pinned` {name: sha256} whose hash differs or that are missing; no rows if all is well."""
    names = hashes.sparkSession.createDataFrame(list(pinned.items()), "name string, wanted string")
    own = hashes.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    return names.join(own, "name", "left").filter(~F.col("sha256").eqNullSafe(F.col("wanted")))


def read_config(path: str) -> dict:
    """A configuration of nested mappings, lists and scalars: JSON, or YAML where its reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def load_env(path: str, into: dict | None = None) -> dict:
    """KEY=VALUE lines, which never replace what is set; blank lines, comments and quotes are seen to."""
    into = os.environ if into is None else into
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, eq, value = line.strip().partition("=")
                if eq and not name.startswith("#"):
                    into.setdefault(name.strip(), value.strip().strip("'\""))
    return into


def environment(modules: list[str], hashes: DataFrame | None = None, pinned: dict[str, str] | None = None) -> list[str]:
    """What a run would lack: modules that cannot be imported, and pinned files that are missing or differ."""
    import importlib.util

    lacking = [f"module {m}" for m in modules if importlib.util.find_spec(m) is None]
    if hashes is not None and pinned:
        lacking += sorted(f"file {r.name}" for r in check_pinned(hashes, pinned).collect())  # at most as many as are pinned
    return lacking
