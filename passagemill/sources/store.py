"""A store of rows in folders by one column (S5, X1, X5, X7, ST1, ST5): points by tenant, chunks by bucket of documents.

A change reads and writes the folders of the rows that it touches and no others. Within a folder rows are
sorted by the store's order (project and document first), and a project that holds a third of all rows lies in
many files. A change is worked out into the shared folder first; putting it in place can then be done again
with the same result, so a job that was lost half-way is simply run again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .shared import written

POINT_ORDER = ("project_id", "document_id", "position", "point_id")


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored rows; None where there is no store yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return None
        raise


def write_store(rows: DataFrame, path: str, partition: str = "tenant_id", order: tuple[str, ...] = POINT_ORDER) -> None:
    """Write rows as whole folders: those of the rows are replaced, others stay. Rows without a partition are refused."""
    keys = [c for c in order if c in rows.columns]
    checked = rows.withColumn(partition, F.coalesce(partition, F.raise_error(F.lit(f"a row without {partition} can't be stored")).cast(rows.schema[partition].dataType)))
    dealt = checked.repartitionByRange(partition, *keys).sortWithinPartitions(partition, *keys)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def touched_rows(old: DataFrame, gone: DataFrame, partition: str) -> DataFrame:
    """The stored rows of the folders that gone names; others are pruned before they are read."""
    least = F.lit("") if isinstance(gone.schema[partition].dataType, StringType) else F.lit(-(2**31))
    # The comparison, true for every value there is, lets Spark take the join as a filter of folders.
    folders = gone.select(partition).where(F.col(partition) >= least).distinct()
    return old.join(folders, partition, "left_semi")


def replace_rows(spark: SparkSession, path: str, fresh: DataFrame | None, keys: list[str], partition: str = "tenant_id", gone: DataFrame | None = None, order: tuple[str, ...] = POINT_ORDER) -> None:
    """Put fresh rows in place of the stored rows of the same keys, and take those of gone(partition, keys...) out.

    keys need not include the partition, by which rows are always told apart. With no fresh row for a key of
    gone, its rows are deleted; a folder left empty is removed. Doing it again changes nothing.
    """
    by = list(dict.fromkeys([partition, *keys]))
    named = [df.select(*by) for df in (fresh, gone) if df is not None]
    out = written((named[0] if len(named) == 1 else named[0].unionByName(named[1])).distinct(), "store-keys")
    old = read_store(spark, path)
    rows = fresh
    if old is not None:
        kept = touched_rows(old, out, partition).join(out, by, "left_anti")
        rows = kept if fresh is None else kept.unionByName(fresh, allowMissingColumns=True)
    if rows is None:
        return
    rows = written(rows, "store-rows")
    write_store(rows, path, partition, order)
    if old is not None:
        emptied = out.select(partition).distinct().join(rows.select(partition).distinct(), partition, "left_anti")
        _remove_folders(spark, path, partition, [r[0] for r in emptied.collect()])


def _remove_folders(spark: SparkSession, path: str, partition: str, values: list) -> None:
    """Dynamic overwriting leaves folders without new rows as they are."""
    if not values:
        return
    jvm = spark.sparkContext._jvm
    names = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    files = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for value in values:
        files.delete(jvm.org.apache.hadoop.fs.Path(path, f"{partition}={names.escapePathName(str(value))}"), True)


def upsert_points(spark: SparkSession, path: str, new: DataFrame) -> None:
    """points(tenant_id, point_id, ...); of rows of one tenant and id the latest by ingested_at, then any, stays."""
    latest = [F.desc(c) for c in ("ingested_at",) if c in new.columns]
    one = Window.partitionBy("tenant_id", "point_id").orderBy(*latest, F.xxhash64(*new.columns))
    fresh = new.withColumn("__place", F.row_number().over(one)).where("__place = 1").drop("__place")
    replace_rows(spark, path, fresh, ["tenant_id", "point_id"])


def delete_documents(spark: SparkSession, path: str, gone: DataFrame) -> None:
    """The points of gone(tenant_id, document_id) leave the store."""
    replace_rows(spark, path, None, ["tenant_id", "document_id"], gone=gone)


def replace_documents(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """All stored points of the documents of fresh give way to it."""
    replace_rows(spark, path, fresh, ["tenant_id", "document_id"])
