"""Counts and reports over catalogue tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearledger.operators.catalogue import count_by, top_values
from gearledger.operators.ranking import cap_per_group, latest

FLAGS = ("missing_image", "missing_mpn", "missing_specs", "needs_review")


def catalog_totals(components: DataFrame) -> DataFrame:
    """One scan for the total and all flag counts."""
    return components.agg(F.count("*").alias("total"), *[F.count_if(F.col(f)).alias(f) for f in FLAGS])


def coverage_by_source(sources: DataFrame) -> DataFrame:
    """Distinct components per source; pairs are made distinct first, so a hot source is combined early."""
    pairs = sources.select("source_key", "component_id").distinct()
    return pairs.groupBy("source_key").agg(F.count("*").alias("components"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of each source, later id among equal start times."""
    return latest(runs, ["source_key"], ["started_at", "run_id"])


def pending_duplicates(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count_if(F.col("status") == "pending").alias("count"))


def statistics(components: DataFrame, sources: DataFrame, runs: DataFrame, pairs: DataFrame, brands: int = 30) -> DataFrame:
    """The whole report as rows ``(section, name, value)``."""
    def rows(df: DataFrame, section: str, name: Column, value: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("bigint").alias("value"))

    totals = catalog_totals(components)
    unpivoted = totals.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("total", *FLAGS)
    ])))
    parts = [
        rows(unpivoted, "totals", F.col("name"), F.col("value")),
        rows(count_by(components, "category"), "category", F.col("category"), F.col("count")),
        rows(top_values(components, "brand", brands), "brand", F.col("brand"), F.col("count")),
        rows(coverage_by_source(sources), "source", F.col("source_key"), F.col("components")),
        rows(latest_runs(runs), "last_run", F.col("source_key"), F.col("run_id")),
        rows(pending_duplicates(pairs), "duplicates", F.lit("pending"), F.col("count")),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def import_report(outcomes: DataFrame, samples: int = 20) -> DataFrame:
    """Counters of an import per source with a per-category map and the first error samples.

    ``outcomes``: source_key, read_no, record_id, category, outcome (created, updated, skipped, error), message.
    """
    counters = [F.count("*").alias("read")] + [
        F.count_if(F.col("outcome") == o).alias(n)
        for o, n in (("created", "created"), ("updated", "updated"), ("skipped", "skipped"), ("error", "errors"))
    ]
    totals = outcomes.groupBy("source_key").agg(*counters)
    categories = outcomes.filter(F.col("category").isNotNull()).groupBy("source_key", "category").agg(F.count("*").alias("n"))
    by_category = categories.groupBy("source_key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories")
    )
    first = cap_per_group(outcomes.filter(F.col("outcome") == "error"), ["source_key"], ["read_no"], samples)
    shown = first.groupBy("source_key").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("read_no", "record_id", "message"))),
        lambda x: F.struct(x["record_id"], x["message"]),
    ).alias("error_samples"))
    return totals.join(by_category, "source_key", "left").join(shown, "source_key", "left")


def numeric_keys(specs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Keys whose values are all numbers or absent. ``specs``: group columns, key, kind."""
    return specs.groupBy(*group, "key").agg(F.every(F.col("kind").isin("number", "null")).alias("numeric"))
