"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gearledger.session import cut_lineage, ensure_checkpoint_dir

__all__ = ["WORD", "cut_lineage", "discard", "documents", "ensure_checkpoint_dir", "held_out", "sampled", "stored", "table", "text_or_empty"]

#: A word: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """True for the rows that no model may learn from: crc32 of the key as text divides by ``folds``. A null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def sampled(rows: DataFrame, group: str, size: int, max_groups: int | None = None, key: str = "doc_id") -> DataFrame:
    """(key, group) of about ``size`` rows of each group, or of the ``max_groups`` largest ones, those with the smallest hash of their key.

    Groups are thinned by the hash to some ``size`` * 4 rows first, where they lie: the group sizes are one row per group, which every
    task gets. So ranking moves a bounded number of rows however large a group is.
    """
    steps = 1 << 30
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    if max_groups is not None:
        sizes = sizes.orderBy(F.desc("group_size"), group).limit(max_groups)
    share = F.least(F.lit(steps), F.ceil(F.lit(4 * size) * F.lit(float(steps)) / F.col("group_size")))
    few = rows.select(key, group).join(F.broadcast(sizes), group).filter(F.pmod(F.xxhash64(key), F.lit(steps)) < share)
    order = Window.partitionBy(group).orderBy(F.pmod(F.xxhash64(key), F.lit(steps)), key)
    return few.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= size).select(key, group).distinct()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Write a frame to a table in the shared folder that the cluster names; the table and its path, for ``discard``."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored`` when everything read from it has been written itself."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
