"""Price trajectory, purchase verdict, listing appraisal."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearledger.catalogue_queries.shapes import LISTINGS, OBSERVATIONS, PRODUCTS, plain_sql, products, round_sql, shape
from gearledger.model.dimensions import ANNUAL_RETENTION, CATEGORY_RISK, CONDITION_FACTOR, SERVICE_LIFE
from gearledger.plans.pricing import appraise, ordered_points, price_insight, price_summary, price_track, value_median, with_launch_price

YEAR = 2026


def q_price_track(spark, folder):
    return price_track(products(spark, folder), shape(spark, folder, OBSERVATIONS), YEAR)


def q_price_summary(spark, folder):
    return price_summary(products(spark, folder), YEAR)


def q_value_median(spark, folder):
    return value_median(products(spark, folder))


def q_price_insight(spark, folder):
    found = price_insight(products(spark, folder), YEAR)
    codes = F.array_join(F.transform("reasons", lambda r: r["code"]), ",")
    return found.withColumn("reasons", codes)


def q_appraise_listings(spark, folder):
    return appraise(shape(spark, folder, LISTINGS), products(spark, folder), YEAR)


def q_launch_prices(spark, folder):
    prices = shape(spark, folder, LAUNCH)
    return with_launch_price(products(spark, folder).select("product_id", "launch_price", "name"), prices).select("product_id", "name", "launch_price")


def q_price_points(spark, folder):
    """Modelled points of each product in year and value order."""
    points = ordered_points(price_track(products(spark, folder), None, YEAR))
    shown = F.transform("points", lambda p: F.concat_ws(":", p["year"].cast("string"), p["value"].cast("bigint").cast("string"), p["kind"]))
    return points.select("product_id", F.array_join(shown, ",").alias("points"))


LAUNCH = "SELECT o_custkey AS product_id, max(floor(o_totalprice)) AS launch_price FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey"


def _case(values: dict, column: str = "category") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


P = plain_sql(PRODUCTS)
SCORE = f"CASE WHEN performance <> 0 AND coalesce(used_price, new_price) <> 0 THEN {round_sql('performance / coalesce(used_price, new_price) * 100')} END"
DROP = f"CASE WHEN launch_price IS NOT NULL AND new_price IS NOT NULL THEN {round_sql('(1 - new_price / launch_price) * 100')} END"

TRACK_SQL = f"""WITH p AS (SELECT *, CASE WHEN year IS NOT NULL THEN greatest(0, {YEAR} - year) END AS span FROM ({P})),
a AS (SELECT *, CASE WHEN new_price > 0 THEN pow(new_price / launch_price, 1.0 / span) ELSE {_case(ANNUAL_RETENTION)} END AS retention
  FROM p WHERE launch_price IS NOT NULL AND year IS NOT NULL AND span > 0),
s AS (SELECT *, unnest(range(1, span + 1)) AS step FROM a)
SELECT product_id, year, launch_price AS value, 'launch' AS kind FROM p WHERE launch_price IS NOT NULL AND year IS NOT NULL
UNION ALL
SELECT product_id, year + step, {round_sql('CASE WHEN step = span AND new_price IS NOT NULL THEN new_price ELSE launch_price * pow(retention, step) END')},
  CASE WHEN step = span AND new_price IS NOT NULL THEN 'current' ELSE 'modelled' END FROM s
UNION ALL
SELECT product_id, {YEAR}, new_price, 'current' FROM p WHERE launch_price IS NOT NULL AND year IS NOT NULL AND span = 0 AND new_price IS NOT NULL
UNION ALL
SELECT product_id, year(observed_on), price, 'observed' FROM ({plain_sql(OBSERVATIONS)})"""

SUMMARY_SQL = f"""SELECT product_id, launch_price AS launch, new_price AS current, used_price AS used, {DROP} AS drop_percent,
  CASE WHEN launch_price IS NOT NULL AND new_price IS NOT NULL AND greatest(0, {YEAR} - year) > 0
    THEN {round_sql(f'(1 - pow(new_price / launch_price, 1.0 / greatest(0, {YEAR} - year))) * 100')} END AS annual_percent,
  CASE WHEN launch_price IS NULL OR year IS NULL THEN 'none' WHEN {YEAR} - year > 0 AND new_price > 0 THEN 'interpolated'
    WHEN {YEAR} - year > 0 THEN 'category-retention' WHEN new_price IS NOT NULL THEN 'released-this-year' ELSE 'none' END AS method
FROM ({P})"""

MEDIAN_SQL = f"""SELECT category, {round_sql('median(score)')} AS median_score, CAST(count(*) AS BIGINT) AS scored
FROM (SELECT category, {SCORE} AS score FROM ({P})) WHERE score IS NOT NULL GROUP BY category"""

INSIGHT_SQL = f"""WITH m AS ({MEDIAN_SQL}),
b AS (SELECT p.product_id, p.category, new_price, used_price, {DROP} AS drop_percent, {SCORE} AS value_score, median_score,
    CASE WHEN year IS NOT NULL THEN greatest(0, {YEAR} - year) END AS age, {_case(SERVICE_LIFE, 'p.category')} AS life, CASE WHEN p.category IN ('cpu', 'motherboard') THEN socket END AS socket
  FROM ({P}) p LEFT JOIN m ON p.category = m.category),
g AS (SELECT *, {round_sql('(value_score - median_score) / median_score * 100')} AS gap FROM b),
f AS (SELECT *,
    CASE WHEN drop_percent IS NULL THEN NULL WHEN drop_percent >= 45 THEN 'drop-done' WHEN drop_percent >= 20 THEN 'drop-running'
      WHEN drop_percent >= 0 THEN 'drop-small' ELSE 'above-launch' END AS f1,
    CASE WHEN gap IS NULL THEN NULL WHEN gap >= 12 THEN 'value-above' WHEN gap <= -12 THEN 'value-below' ELSE 'value-average' END AS f2,
    CASE WHEN age IS NULL THEN NULL WHEN age >= life THEN 'past-life' WHEN age >= life * 0.65 THEN 'late-life' WHEN age <= 1 THEN 'recent' ELSE 'mature' END AS f3,
    CASE WHEN socket IS NULL THEN NULL WHEN socket IN ('AM5', 'LGA1851') THEN 'socket-active' WHEN socket IN ('AM4', 'LGA1700') THEN 'socket-mature' ELSE 'socket-closed' END AS f4
  FROM g),
w AS (SELECT *, CAST((f1 IS NOT NULL) AS INT) + CAST((f2 IS NOT NULL) AS INT) + CAST((f3 IS NOT NULL) AS INT) + CAST((f4 IS NOT NULL) AS INT) AS factors,
    greatest(0, least(100, 50
      + CASE f1 WHEN 'drop-done' THEN 18 WHEN 'drop-running' THEN 6 WHEN 'drop-small' THEN -10 WHEN 'above-launch' THEN -14 ELSE 0 END
      + CASE f2 WHEN 'value-above' THEN 16 WHEN 'value-below' THEN -16 ELSE 0 END
      + CASE f3 WHEN 'past-life' THEN -18 WHEN 'late-life' THEN -8 WHEN 'mature' THEN 8 ELSE 0 END
      + CASE f4 WHEN 'socket-active' THEN 14 WHEN 'socket-closed' THEN -14 ELSE 0 END)) AS bounded
  FROM f)
SELECT product_id, category,
  CASE WHEN factors = 0 THEN 'Données insuffisantes' WHEN bounded >= 72 THEN 'Bon achat aujourd’hui' WHEN bounded >= 56 THEN 'Achat défendable'
    WHEN bounded >= 40 THEN 'À surveiller' ELSE 'Difficile à conseiller aujourd’hui' END AS verdict,
  CASE WHEN factors > 0 THEN CAST(bounded AS DOUBLE) END AS score,
  CASE WHEN factors >= 3 THEN 'Bonne' WHEN factors >= 2 THEN 'Moyenne' ELSE 'Faible' END AS confidence,
  concat_ws(',', CASE WHEN drop_percent IS NULL THEN 'drop-unknown' END, f1, f2, f3, f4,
    CASE WHEN new_price IS NULL AND used_price IS NULL THEN 'no-price' END) AS reasons,
  factors, drop_percent, value_score, median_score, age FROM w"""

# Figures are written with exponents so that they are doubles and not exact decimals.
APPRAISE_SQL = f"""WITH j AS (SELECT l.*, p.category, CASE WHEN p.year IS NOT NULL THEN greatest(0, {YEAR} - p.year) END AS age, new_price, used_price FROM ({plain_sql(LISTINGS)}) l
    JOIN ({P}) p ON l.product_id = p.product_id),
e AS (SELECT *, greatest(0, price) + greatest(0, shipping) + greatest(0, protection) AS total,
    coalesce(used_price, CASE WHEN new_price <> 0 THEN new_price * greatest(25e-2, 84e-2 - coalesce(age, 0) * 55e-3) END) AS base,
    CASE WHEN warranty THEN 4e-2 ELSE 0e0 END + CASE WHEN invoice THEN 25e-3 ELSE 0e0 END + CASE WHEN box THEN 2e-2 ELSE 0e0 END
      + CASE WHEN tested THEN 4e-2 ELSE -5e-2 END + CASE WHEN benchmarks THEN 25e-3 ELSE 0e0 END + CASE WHEN professional THEN 25e-3 ELSE 0e0 END AS evidence,
    CAST(invoice AS INT) + CAST(warranty AS INT) + CAST(tested AS INT) + CAST(benchmarks AS INT) AS proofs,
    CAST({_case(CONDITION_FACTOR, 'condition')} AS DOUBLE) * CAST({_case(CATEGORY_RISK)} AS DOUBLE) AS factors FROM j),
t AS (SELECT *, {round_sql('base * factors * (1 + CAST(evidence AS DOUBLE))')} AS target FROM e),
d AS (SELECT *, {round_sql('target * 1.1')} AS maximum, {round_sql('(total - target) / target * 100')} AS delta FROM t)
SELECT listing_id, product_id, total, age,
  CASE WHEN base IS NULL THEN 'Données insuffisantes' WHEN condition = 'repair' THEN 'Faible' WHEN proofs >= 3 THEN 'Bonne' WHEN proofs >= 1 THEN 'Moyenne' ELSE 'Faible' END AS confidence,
  target, maximum,
  CASE WHEN base IS NULL THEN 'Données insuffisantes'
    WHEN condition IN ('untested', 'repair') THEN CASE WHEN total > target THEN 'Risque élevé' ELSE 'Prix à négocier' END
    WHEN delta <= -18 THEN 'Excellente affaire' WHEN delta <= -7 THEN 'Bon prix' WHEN delta <= 6 THEN 'Prix correct'
    WHEN delta <= 18 THEN 'Prix à négocier' ELSE 'Trop cher' END AS verdict,
  CASE WHEN base IS NULL THEN 0.0 ELSE greatest(0, least(100, {round_sql('75 - delta + CAST(evidence AS DOUBLE) * 100')})) END AS score, delta
FROM d"""

POINTS_SQL = f"""SELECT product_id, string_agg(year || ':' || CAST(value AS BIGINT) || ':' || kind, ',' ORDER BY year, value, kind) AS points
  FROM ({TRACK_SQL}) WHERE kind <> 'observed' GROUP BY product_id"""
LAUNCH_SQL = f"SELECT p.product_id, p.name, l.launch_price FROM ({P}) p LEFT JOIN ({plain_sql(LAUNCH)}) l ON p.product_id = l.product_id"

QUERIES = {
    "launch_prices": q_launch_prices, "price_points": q_price_points,
    "price_track": q_price_track, "price_summary": q_price_summary, "value_median": q_value_median,
    "price_insight": q_price_insight, "appraise_listings": q_appraise_listings,
}
ORACLES = {
    "launch_prices": LAUNCH_SQL, "price_points": POINTS_SQL,
    "price_track": TRACK_SQL, "price_summary": SUMMARY_SQL, "value_median": MEDIAN_SQL, "price_insight": INSIGHT_SQL,
    "appraise_listings": APPRAISE_SQL,
}
