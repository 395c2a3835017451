"""Ranking, first/last wins, round robin, carry-forward and positions.

Per-group caps use ``row_number() <= n``: Spark then limits every group before the shuffle, so a hot group
moves at most ``n`` rows per task. First/last wins are aggregates with map-side combination, never windows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from gearledger.session import cut_lineage


def cap_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group. The limit is the feature: a quota per group."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def _keep_one(df: DataFrame, keys: Sequence[str], pick: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def _row(df: DataFrame, keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in df.columns if c not in keys])


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``order`` (which should end in a unique column)."""
    return _keep_one(df, keys, F.min_by(_row(df, keys), F.struct(*order)))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the largest by ``order``."""
    return _keep_one(df, keys, F.max_by(_row(df, keys), F.struct(*order)))


def round_robin(df: DataFrame, group: str, order: Sequence[Column | str], limit: int) -> DataFrame:
    """Take one row of each group in turn, groups in name order, until ``limit`` rows are chosen.

    A group can supply at most ``limit`` rows, so it is cut to that before the final top-k.
    """
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    ranked = df.withColumn("turn", turn).filter(F.col("turn") <= limit)
    return ranked.orderBy("turn", group).limit(limit)


def carry_forward(
    df: DataFrame, headers: Sequence[str], keys: Sequence[str], line: str, chunk_rows: int = 100_000
) -> DataFrame:
    """Fill every header column with its last non-null value on an earlier or the same line.

    ``line`` is an integer line number within ``keys``. Lines are cut into chunks of ``chunk_rows`` numbers;
    only one summary row per chunk is carried across chunks, so one huge document is still spread over tasks.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(line) / F.lit(chunk_rows)))
    marked = chunked.groupBy(*keys, "_chunk").agg(
        *[F.max_by(h, F.when(F.col(h).isNotNull(), F.col(line))).alias(f"_last_{h}") for h in headers]
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.select(
        *keys, "_chunk", *[F.last(f"_last_{h}", ignorenulls=True).over(before).alias(f"_in_{h}") for h in headers]
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(line).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = chunked.join(carried, [*keys, "_chunk"], "left")
    filled = {h: F.coalesce(F.last(h, ignorenulls=True).over(inside), F.col(f"_in_{h}")) for h in headers}
    return joined.withColumns(filled).select(*df.columns)


def with_position(df: DataFrame, order: Sequence[Column | str], name: str = "position", cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Dense global position from 0 without a single-task window.

    The rows are range-partitioned and materialised once, then each partition adds the number of rows of the
    partitions before it (one row per partition, so that side is small by construction).
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    stored = cut(ranged)
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_row") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    return stored.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_offset") + local).alias(name))


def neighbours(products: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` products of the same category nearest in performance, ties in id order.

    Works on distinct performance levels: each level keeps its first ``k + 1`` products, levels get a dense
    position, and the ``k`` levels on either side are found by an equi-join on that position.
    """
    rated = products.filter(F.col("performance").isNotNull()).select("category", "performance", "product_id")
    members = cap_per_group(rated, ["category", "performance"], ["product_id"], k + 1)
    levels = with_position(members.select("category", "performance").distinct(), ["category", "performance"])
    around = levels.select(
        "category", "performance", F.explode(F.sequence(F.col("position") - k, F.col("position") + k)).alias("position")
    )
    near = around.join(
        levels.select("category", F.col("performance").alias("near"), "position"), ["category", "position"]
    )
    choices = near.join(
        members.select("category", F.col("performance").alias("near"), F.col("product_id").alias("other")), ["category", "near"]
    )
    gap = F.abs(F.col("near") - F.col("performance"))
    shortlist = choices.groupBy("category", "performance").agg(
        F.array_sort(F.collect_list(F.struct(gap.alias("gap"), F.col("other").alias("product_id")))).alias("near")
    )
    ranked = rated.join(shortlist, ["category", "performance"]).select(
        "product_id", F.slice(F.filter("near", lambda n: n["product_id"] != F.col("product_id")), 1, k).alias("near")
    )
    return ranked.select("product_id", F.posexplode("near").alias("position", "n")).select(
        "product_id", (F.col("position") + 1).alias("rank"), F.col("n.product_id").alias("neighbour_id"), F.col("n.gap").alias("gap")
    )
