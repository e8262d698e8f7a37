"""Cutting lineage and choosing partitions.

Intermediate tables go to the shared folder the session names in
`spark.checkpoint.dir`, so a lost executor never loses them.  Only where the
setting is unset and all runs in one process (local tests) a folder of this
machine is taken; on a cluster without the setting nothing is written.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only up to this many rows and bytes (of its values as text, with 16 for each row).
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 32_000_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; set here only where the session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="qirtas-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: the plan starts anew there.

    The files are removed when the application ends.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/qirtas-{uuid.uuid4().hex}"
    df.write.parquet(place)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(place)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(place)


def _written_files(df: DataFrame) -> list[str]:
    """The files `df` reads, if all are of `materialize`; else none."""
    files = df.inputFiles()
    return files if files and all("/qirtas-" in f for f in files) else []


def drop_table(*tables: DataFrame) -> None:
    """Remove the files behind tables of `materialize` that no later plan reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/qirtas-" in name:
                at = context._jvm.org.apache.hadoop.fs.Path(name)
                at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes of the values as text, with 16 for each row) of a written table."""
    size = F.lit(16)
    for c in df.columns:
        size = size + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0))
    return tuple(df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first())


def small_or_not(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it is proven to have at most `most` rows and `most_bytes` bytes, else without (a shuffled join follows).

    What is measured is a written table: a plan over others is written first, so it is not run twice.
    """
    if not _written_files(df):
        df = materialize(df)
    rows, held = measured(df)
    return F.broadcast(df) if rows <= most and held <= most_bytes else df


def looked_up(df: DataFrame, table: DataFrame, small: bool, on: tuple[str, str], salts: int = 16) -> DataFrame:
    """`df` left joined with `table` on df's column on[0] = table's column on[1], which table has once.

    A small table is broadcast.  Otherwise the rows of each key are dealt to `salts` tasks by their contents, and the
    table is repeated for each, so that a key of very many rows is not one task's.
    """
    if small:
        return df.join(F.broadcast(table), F.col(on[0]) == F.col(on[1]), "left")
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)).cast("int")
    repeated = table.withColumn("_salt_2", F.explode(F.array(*map(F.lit, range(salts)))))
    return df.withColumn("_salt_1", salt).join(repeated, (F.col(on[0]) == F.col(on[1])) & (F.col("_salt_1") == F.col("_salt_2")), "left").drop("_salt_1", "_salt_2")


def spread(df: DataFrame) -> DataFrame:
    """Enough partitions for all cores where tables come in fewer splits than that; else unchanged.

    Only plans without an exchange are looked at: counting the partitions of another would run it.  The rows are dealt
    out by a hash of their contents, so a retried task yields the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString() or execution.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, *[F.col(f"`{c}`") for c in df.columns])


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session's executors (once per application)."""
    import os
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_qirtas_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    local = os.path.join(tempfile.mkdtemp(prefix="qirtas-"), "qirtas.zip")  # the driver serves it to the executors
    with zipfile.ZipFile(local, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("qirtas", os.path.relpath(path, root)))
    context.addPyFile(local)
    context._qirtas_shipped = True
