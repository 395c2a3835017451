"""Set operations between feeds: unions, overlays, exclusions and integrity checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearledger.functions.text import fold_text


def union_feeds(*feeds: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def overlay(base: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fresh rows replace stored rows of the same key."""
    return base.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def known_identities(products: DataFrame) -> DataFrame:
    """Distinct folded names and references."""
    return products.select(F.explode(F.array(fold_text(F.col("name")), fold_text(F.col("reference")))).alias("identity")).filter(
        F.col("identity") != ""
    ).distinct()


def flag_known(candidates: DataFrame, identities: DataFrame, label: str = "label") -> DataFrame:
    """Mark candidates whose folded label is already a catalogue identity."""
    marked = identities.withColumn("_known", F.lit(True))
    return candidates.withColumn("_identity", fold_text(F.col(label))).join(
        marked, F.col("_identity") == F.col("identity"), "left"
    ).withColumn("duplicate", F.coalesce("_known", F.lit(False))).drop("_identity", "identity", "_known")


def exclude_known(imported: DataFrame, curated: DataFrame, key: str = "product_id") -> DataFrame:
    """Imported rows of which neither name nor reference is an identity of the curated set."""
    identities = curated.select(F.explode(F.array(fold_text(F.col("name")), fold_text(F.col("reference")))).alias("identity")).distinct()
    taken = imported.select(
        key, F.explode(F.array_distinct(F.array(fold_text(F.col("name")), fold_text(F.col("reference"))))).alias("identity")
    ).join(identities, "identity", "left_semi").select(key).distinct()
    return imported.join(taken, key, "left_anti")


def merge_candidates(previous: DataFrame, discovered: DataFrame, run: str = "run_no") -> DataFrame:
    """One row per id: the newest version, keeping the first-seen date of the stored one.

    Within the discovered rows the highest ``run`` number is the newest.
    """
    columns = [c for c in discovered.columns if c not in ("candidate_id", run)]
    tagged = previous.withColumn(run, F.lit(-1).cast("bigint")).unionByName(discovered, allowMissingColumns=True)
    newest = F.max_by(F.struct(*columns), F.col(run))
    oldest = F.min_by("first_seen", F.col(run))
    merged = tagged.groupBy("candidate_id").agg(newest.alias("w"), oldest.alias("seen"))
    return merged.select(
        "candidate_id", *[(F.col("seen").alias(c) if c == "first_seen" else F.col("w")[c].alias(c)) for c in columns]
    )


def candidate_queue(candidates: DataFrame, limit: int) -> DataFrame:
    """Review order: unknown identities first, then category, brand, label; cut to the queue length."""
    return candidates.orderBy("duplicate", "category", F.lower("brand"), F.lower("label"), "candidate_id").limit(limit)


def drop_promoted(candidates: DataFrame, promoted: DataFrame) -> DataFrame:
    return candidates.join(promoted.select("candidate_id"), "candidate_id", "left_anti")


def only_enabled(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    return candidates.join(sources.filter("enabled").select("source_id"), "source_id", "left_semi")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def same_set(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values on one side only: empty when the two sets are equal."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return a.join(b, column, "left_anti").withColumn("side", F.lit("left")).unionByName(
        b.join(a, column, "left_anti").withColumn("side", F.lit("right"))
    )


def update_ledger(ledger: DataFrame, results: DataFrame, run_date: str) -> DataFrame:
    """Failure ledger after a run: successes leave it, failures count one attempt more.

    ``ledger``: candidate_id, attempts, last_attempt, error. ``results``: candidate_id, error (null = success).
    """
    joined = ledger.join(results.select("candidate_id", F.col("error").alias("new_error"), F.lit(True).alias("tried")), "candidate_id", "full_outer")
    kept = joined.filter(F.col("tried").isNull() | F.col("new_error").isNotNull())
    tried = F.col("tried").isNotNull()
    return kept.select(
        "candidate_id",
        (F.coalesce("attempts", F.lit(0)) + F.when(tried, 1).otherwise(0)).alias("attempts"),
        F.when(tried, F.lit(run_date)).otherwise(F.col("last_attempt")).alias("last_attempt"),
        F.coalesce("new_error", "error").alias("error"),
    )
