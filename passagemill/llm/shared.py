"""What the operators of this subpackage share: staged tables, word splitting and integer mixing.

A *staged table* is a Parquet table in the folder that ``spark.checkpoint.dir`` names. It cuts the
lineage of a step whose rows carry ids made in a task, so a lost executor never leads to other ids.
"""

from __future__ import annotations

import gc
import os
import sys
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Words are runs of bytes other than space and \t \n \v \f \r; bytes.split() cuts at just these.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; a temporary one only where all runs in one process, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="passagemill-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/passagemill/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back with the schema that it had."""
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP, "false")
    # The shuffle files of this step have no further use once its table is there.
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    schema = df.schema
    del df
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are staged by now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give the memory of a task's arrays back; Python workers live on between tasks."""
    if sys.platform == "linux":
        import ctypes

        getattr(ctypes.CDLL(None), "malloc_trim", lambda n: 0)(0)


def task_id() -> int:
    """A number for this task attempt's rows; unique once the attempt's output is committed."""
    return int.from_bytes(os.urandom(8), "little") >> 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public murmur3 constants), elementwise."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key of an ordered pair of 64-bit keys."""
    with np.errstate(over="ignore"):
        return mix(a * GOLDEN + mix(b + np.uint64(1)))


def as_text(value) -> str:
    return "" if value is None else value


class BoundedCache(dict):
    """A memo of at most ``limit`` entries; it starts anew when full, so that memory stays bounded."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """An equi-join in which nulls match; right must hold each key once and share no other name."""
    from pyspark.sql import functions as F

    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [left[k].eqNullSafe(named[f"__{k}"]) for k in keys]
    return left.join(named, on, how).drop(*[F.col(f"__{k}") for k in keys])


def drop_lines(documents: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """documents without the lines that removed(keys..., __lines array<int>) numbers from 0.

    documents must have the key columns; n_chars, where there is one, follows the text.
    """
    from pyspark.sql import functions as F

    def left(lines):
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__lines"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    # As a variable of a lambda, the lines are split once and not for each of them.
    text = F.get(F.transform(F.array(F.split(F.col("text"), "\n", -1)), left), 0)
    text = F.when(F.col("__lines").isNull(), F.col("text")).otherwise(text)
    # The lists are hashed and the texts not sorted; both sides are dealt out at any size.
    out = null_safe_join(documents, removed.hint("shuffle_hash"), keys).withColumn("text", text).drop("__lines")
    if "n_chars" in documents.columns:
        changed = F.length("text").cast(documents.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", changed)
    return out
