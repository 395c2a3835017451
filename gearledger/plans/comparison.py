"""Comparison of products and recommendation of starter builds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from gearledger.functions.scores import value_score
from gearledger.functions.specs import display
from gearledger.model import inline_table
from gearledger.model.dimensions import COMPACT_STARTER, DEFAULT_STARTER, STARTER_RULES
from gearledger.operators.ranking import cap_per_group
from gearledger.plans.compatibility import audit

PLACES = 4


def compared(selections: DataFrame, products: DataFrame) -> DataFrame:
    """Products of each comparison, at most four of the category of the first one.

    ``selections``: comparison_id, position, product_id.
    """
    joined = selections.join(products, "product_id")
    lead = joined.groupBy("comparison_id").agg(F.min_by("category", "position").alias("_category"))
    same = joined.join(lead, "comparison_id").filter(F.col("category") == F.col("_category")).drop("_category")
    kept = cap_per_group(same, ["comparison_id"], ["position"], PLACES)
    place = F.row_number().over(Window.partitionBy("comparison_id").orderBy("position"))
    return kept.withColumn("place", place)


def best_flags(rows: DataFrame) -> DataFrame:
    """Best performance and best value score inside each comparison."""
    scored = rows.withColumn("value_score", value_score(F.col("performance"), F.col("used_price"), F.col("new_price")))
    whole = Window.partitionBy("comparison_id")
    best = lambda c: F.coalesce(F.col(c) == F.max(c).over(whole), F.lit(False))
    return scored.select(
        "comparison_id", "product_id", "place", "performance", "value_score",
        best("performance").alias("best_performance"), best("value_score").alias("best_value"),
    )


def comparison_matrix(rows: DataFrame) -> DataFrame:
    """One row per specification key with a column per place.

    ``numeric`` tells that every compared product gives a number or nothing; keys come in order of appearance.
    """
    specs = rows.select("comparison_id", "place", F.posexplode(F.map_entries("specs")).alias("at", "e")).select(
        "comparison_id", "place", "at", F.col("e.key").alias("key"), F.col("e.value").alias("spec")
    )
    cells = [F.max(F.when(F.col("place") == p, display(F.col("spec")))).alias(f"p{p}") for p in range(1, PLACES + 1)]
    return specs.groupBy("comparison_id", "key").agg(
        F.every(F.col("spec.kind").isin("number", "null")).alias("numeric"), F.min(F.struct("place", "at")).alias("first_seen"), *cells
    )


def choose_starter(requests: DataFrame) -> DataFrame:
    """Starter of each request (request_id, budget, resolution, compact): first rule that fits.

    The rules are a fixed chain of conditions, so no join is needed.
    """
    chain = F.when(F.col("compact"), COMPACT_STARTER)
    for top, resolutions, starter in STARTER_RULES:
        chain = chain.when((F.col("budget") <= F.lit(top)) & F.col("resolution").isin(*resolutions), starter)
    return requests.withColumn("starter", chain.otherwise(DEFAULT_STARTER))


def recommend(requests: DataFrame, starter_builds: DataFrame, products: DataFrame) -> DataFrame:
    """Chosen starter with its summary and verdict. ``starter_builds``: build_id (starter), slot, product_id.

    Each starter is audited once, whatever the number of requests.
    """
    names = inline_table(requests.sparkSession, "starter string", [(s,) for s in sorted({r[2] for r in STARTER_RULES} | {COMPACT_STARTER, DEFAULT_STARTER})])
    audited = audit(starter_builds.join(F.broadcast(names), F.col("build_id") == F.col("starter"), "left_semi"), products)
    facts = audited.select(F.col("build_id").alias("starter"), "total", "estimated", "recommended", "gaming", "verdict")
    chosen = choose_starter(requests)
    # One row per fixed starter name: bounded.
    return chosen.join(F.broadcast(facts), "starter", "left").withColumn("over_budget", F.col("total") > F.col("budget"))
