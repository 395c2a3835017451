"""Price trajectory, purchase verdict and listing appraisal.

Every step is a column expression over one product row, except the category median, which is taken from a
pre-aggregated histogram (distinct scores per category) and joined back by broadcast: it holds one row per
known category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearledger.functions.numbers import clamp, js_round
from gearledger.functions.scores import value_score
from gearledger.functions.specs import text_of
from gearledger.model import literal_map
from gearledger.model.dimensions import (
    ACTIVE_SOCKETS, ANNUAL_RETENTION, CATEGORIES, CATEGORY_RISK, CONDITION_FACTOR, MATURE_SOCKETS, SERVICE_LIFE,
)


def age(year: Column, as_of_year: int) -> Column:
    # greatest() skips nulls: an unknown year must stay unknown.
    return F.when(year.isNotNull(), F.greatest(F.lit(0), F.lit(as_of_year) - year))


def with_launch_price(products: DataFrame, launch_prices: DataFrame) -> DataFrame:
    """Add the documented launch price; a product that is not listed keeps none. ``launch_prices``: product_id, launch_price."""
    return products.drop("launch_price").join(launch_prices.select("product_id", "launch_price"), "product_id", "left")


def ordered_points(points: DataFrame) -> DataFrame:
    """Points of each product as one array in (year, value) order."""
    point = F.struct("year", "value", "kind")
    return points.groupBy("product_id").agg(F.array_sort(F.collect_list(point)).alias("points"))


def drop_percent(launch: Column, current: Column) -> Column:
    return F.when(launch.isNotNull() & current.isNotNull(), js_round((1 - F.try_divide(current, launch)) * 100))


def annual_percent(launch: Column, current: Column, span: Column) -> Column:
    yearly = F.pow(F.try_divide(current, launch), F.try_divide(F.lit(1.0), span.cast("double")))
    return F.when(launch.isNotNull() & current.isNotNull() & (span > 0), js_round((1 - yearly) * 100))


def price_track(products: DataFrame, observations: DataFrame | None, as_of_year: int) -> DataFrame:
    """Yearly points (launch, modelled, current, observed) of every product.

    ``products``: product_id, category, year, launch_price, new_price.
    ``observations``: product_id, observed_on, price, source.
    """
    span = age(F.col("year"), as_of_year)
    launch, current, year = F.col("launch_price"), F.col("new_price"), F.col("year")
    retention = F.when(current > 0, F.pow(F.try_divide(current, launch), F.try_divide(F.lit(1.0), span.cast("double")))).otherwise(
        literal_map(ANNUAL_RETENTION)[F.col("category")]
    )

    def point(y: Column, value: Column, kind: Column) -> Column:
        return F.struct(
            y.cast("int").alias("year"), value.cast("double").alias("value"), kind.alias("kind")
        )

    none = F.array().cast("array<struct<year:int,value:double,kind:string>>")
    anchored = launch.isNotNull() & year.isNotNull()
    steps = F.transform(
        F.sequence(F.lit(1), span),
        lambda step: point(
            year + step,
            js_round(F.when((step == span) & current.isNotNull(), current).otherwise(launch * F.pow(retention, step))),
            F.when((step == span) & current.isNotNull(), "current").otherwise("modelled"),
        ),
    )
    start = F.when(anchored, F.array(point(year, launch, F.lit("launch")))).otherwise(none)
    rest = (
        F.when(anchored & (span > 0), steps)
        .when(anchored & current.isNotNull(), F.array(point(F.lit(as_of_year), current, F.lit("current"))))
        .otherwise(none)
    )
    points = products.select("product_id", F.inline(F.concat(start, rest)))
    if observations is not None:
        observed = observations.select(
            "product_id", F.year("observed_on").alias("year"), F.col("price").alias("value"), F.lit("observed").alias("kind")
        ).filter(F.col("year").isNotNull())
        points = points.unionByName(observed)
    return points


def price_summary(products: DataFrame, as_of_year: int) -> DataFrame:
    """Cumulated and yearly loss of value of every product."""
    span = age(F.col("year"), as_of_year)
    launch, current = F.col("launch_price"), F.col("new_price")
    method = (
        F.when(launch.isNull() | F.col("year").isNull(), "none")
        .when((span > 0) & (current > 0), "interpolated")
        .when(span > 0, "category-retention")
        .when(current.isNotNull(), "released-this-year")
        .otherwise("none")
    )
    return products.select(
        "product_id", launch.alias("launch"), current.alias("current"), F.col("used_price").alias("used"),
        drop_percent(launch, current).alias("drop_percent"),
        annual_percent(launch, current, span).alias("annual_percent"), method.alias("method"),
    )


def value_median(products: DataFrame) -> DataFrame:
    """Median value score per category; an even count gives the rounded mean of the two middle scores.

    The median is read from a histogram of distinct scores, so a hot category shuffles its distinct scores only.
    """
    scored = products.filter(F.col("category").isin(*CATEGORIES)).select(
        "category", value_score(F.col("performance"), F.col("used_price"), F.col("new_price")).alias("score")
    ).filter(F.col("score").isNotNull())
    histogram = scored.groupBy("category", "score").agg(F.count("*").alias("frequency"))
    return histogram.groupBy("category").agg(
        js_round(F.percentile("score", 0.5, F.col("frequency"))).alias("median_score"), F.sum("frequency").alias("scored")
    )


def price_insight(products: DataFrame, as_of_year: int, medians: DataFrame | None = None) -> DataFrame:
    """Purchase verdict with every factor stated. ``products`` also carries performance, used_price and specs."""
    medians = value_median(products) if medians is None else medians
    # One row per known category, whoever made the table: that is what bounds the broadcast below.
    medians = medians.filter(F.col("category").isin(*CATEGORIES)).groupBy("category").agg(F.max("median_score").alias("median_score"))
    socket = F.when(F.col("category").isin("cpu", "motherboard"), F.nullif(text_of(F.col("specs"), "Socket"), F.lit("")))
    base = products.select(
        "product_id", "category", "new_price", "used_price",
        drop_percent(F.col("launch_price"), F.col("new_price")).alias("drop_percent"),
        value_score(F.col("performance"), F.col("used_price"), F.col("new_price")).alias("value_score"),
        age(F.col("year"), as_of_year).alias("age"),
        socket.alias("socket"),
    ).join(F.broadcast(medians), "category", "left")

    drop, years = F.col("drop_percent"), F.col("age")
    life = literal_map(SERVICE_LIFE)[F.col("category")]
    has_gap = F.col("value_score").isNotNull() & F.col("median_score").isNotNull()
    # A median of zero makes the gap infinite or undefined, never an error.
    difference = F.col("value_score") - F.col("median_score")
    gap = F.when(F.col("median_score") != 0, js_round(difference / F.col("median_score") * 100)).otherwise(
        F.when(difference > 0, F.lit(float("inf"))).when(difference < 0, F.lit(float("-inf")))
    )

    def factor(points: Column, code: Column, status: Column) -> Column:
        return F.struct(points.cast("int").alias("points"), code.alias("code"), status.alias("status"))

    def banded(present: Column, *bands) -> Column:
        chain = None
        for condition, points, code, status in bands:
            value = factor(F.lit(points), F.lit(code), F.lit(status))
            chain = F.when(condition, value) if chain is None else chain.when(condition, value)
        return F.when(present, chain)

    factors = [
        banded(
            drop.isNotNull(), (drop >= 45, 18, "drop-done", "ok"), (drop >= 20, 6, "drop-running", "info"),
            (drop >= 0, -10, "drop-small", "warning"), (F.lit(True), -14, "above-launch", "warning"),
        ),
        banded(
            has_gap, (gap >= 12, 16, "value-above", "ok"), (gap <= -12, -16, "value-below", "warning"),
            (F.lit(True), 0, "value-average", "info"),
        ),
        banded(
            years.isNotNull(), (years >= life, -18, "past-life", "error"), (years >= life * 0.65, -8, "late-life", "warning"),
            (years <= 1, 0, "recent", "info"), (F.lit(True), 8, "mature", "ok"),
        ),
        banded(
            F.col("socket").isNotNull(), (F.col("socket").isin(*ACTIVE_SOCKETS), 14, "socket-active", "ok"),
            (F.col("socket").isin(*MATURE_SOCKETS), 0, "socket-mature", "info"),
            (F.lit(True), -14, "socket-closed", "warning"),
        ),
    ]
    weighed = F.filter(F.array(*factors), lambda f: f.isNotNull())
    unmeasured = F.when(drop.isNull(), factor(F.lit(0), F.lit("drop-unknown"), F.lit("info")))
    unpriced = F.when(
        F.col("new_price").isNull() & F.col("used_price").isNull(), factor(F.lit(0), F.lit("no-price"), F.lit("info"))
    )
    reasons = F.filter(F.array(unmeasured, *factors, unpriced), lambda f: f.isNotNull())
    scored = base.select(
        "product_id", "category", "drop_percent", "value_score", "median_score", "age",
        F.size(weighed).alias("factors"), reasons.alias("reasons"),
        clamp(F.lit(50.0) + F.aggregate(weighed, F.lit(0), lambda acc, f: acc + f["points"]), 0, 100).alias("bounded"),
    )
    count, bounded = F.col("factors"), F.col("bounded")
    verdict = (
        F.when(count == 0, "Données insuffisantes").when(bounded >= 72, "Bon achat aujourd’hui")
        .when(bounded >= 56, "Achat défendable").when(bounded >= 40, "À surveiller")
        .otherwise("Difficile à conseiller aujourd’hui")
    )
    confidence = F.when(count >= 3, "Bonne").when(count >= 2, "Moyenne").otherwise("Faible")
    return scored.select(
        "product_id", "category", verdict.alias("verdict"), F.when(count > 0, bounded).alias("score"),
        confidence.alias("confidence"), "reasons", "factors", "drop_percent", "value_score", "median_score", "age",
    )


def appraise(listings: DataFrame, products: DataFrame, as_of_year: int) -> DataFrame:
    """Target price, ceiling, gap and verdict of every listing whose product is known.

    ``listings``: listing_id, product_id, price, shipping, protection, condition and six booleans.
    """
    subject = products.select("product_id", "category", "year", "new_price", "used_price")
    joined = listings.join(subject, "product_id", "inner")
    years = age(F.col("year"), as_of_year)
    zero = F.lit(0.0)
    total = sum((F.greatest(zero, F.col(name)) for name in ("price", "shipping", "protection")), start=zero)
    fallback = F.when(
        F.col("new_price") != 0,
        F.col("new_price") * F.greatest(F.lit(0.25), F.lit(0.84) - F.coalesce(years, F.lit(0)) * F.lit(0.055)),
    )

    def weight(flag: str, yes: float, no: float = 0.0) -> Column:
        return F.when(F.col(flag), F.lit(yes)).otherwise(F.lit(no))

    evidence = (
        weight("warranty", 0.04) + weight("invoice", 0.025) + weight("box", 0.02) + weight("tested", 0.04, -0.05)
        + weight("benchmarks", 0.025) + weight("professional", 0.025)
    )
    proofs = sum((F.col(f).cast("int") for f in ("invoice", "warranty", "tested", "benchmarks")), start=F.lit(0))
    factors = literal_map(CONDITION_FACTOR)[F.col("condition")] * literal_map(CATEGORY_RISK)[F.col("category")]
    measured = joined.select(
        "listing_id", "product_id", "condition", total.alias("total"), years.alias("age"),
        F.coalesce(F.col("used_price"), fallback).alias("base"), evidence.alias("evidence"), proofs.alias("proofs"),
        factors.alias("factors"),
    ).withColumn("target", js_round(F.col("base") * F.col("factors") * (1 + F.col("evidence"))))
    delta = js_round(F.try_divide(F.col("total") - F.col("target"), F.col("target")) * 100)
    priced = measured.withColumn("maximum", js_round(F.col("target") * 1.1)).withColumn("delta", delta)
    d, known = F.col("delta"), F.col("base").isNotNull()
    risky = F.col("condition").isin("untested", "repair")
    verdict = (
        F.when(~known, "Données insuffisantes")
        .when(risky, F.when(F.col("total") > F.col("target"), "Risque élevé").otherwise("Prix à négocier"))
        .when(d <= -18, "Excellente affaire").when(d <= -7, "Bon prix").when(d <= 6, "Prix correct")
        .when(d <= 18, "Prix à négocier").otherwise("Trop cher")
    )
    confidence = (
        F.when(~known, "Données insuffisantes").when(F.col("condition") == "repair", "Faible")
        .when(F.col("proofs") >= 3, "Bonne").when(F.col("proofs") >= 1, "Moyenne").otherwise("Faible")
    )
    score = F.when(known, clamp(js_round(F.lit(75) - d + F.col("evidence") * 100), 0, 100)).otherwise(F.lit(0.0))
    return priced.select(
        "listing_id", "product_id", "total", "age", confidence.alias("confidence"), "target", "maximum",
        verdict.alias("verdict"), score.alias("score"), "delta",
    )
