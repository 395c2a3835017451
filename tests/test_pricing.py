"""Price trajectory, verdicts and listings."""

import pytest
from pyspark.sql import functions as F

from gearledger.functions.specs import spec_map, text_spec
from gearledger.plans.pricing import appraise, price_insight, price_summary, price_track, value_median

SCHEMA = "product_id string, category string, year int, launch_price double, new_price double, used_price double, performance double, socket string"


@pytest.fixture(scope="module")
def products(spark):
    rows = [
        ("cpu-5600", "cpu", 2022, 199.0, 105.0, 70.0, 72.0, "AM4"), ("cpu-7600", "cpu", 2023, 259.0, 195.0, 145.0, 86.0, "AM5"),
        ("cpu-9900kf", "cpu", 2019, 499.0, None, 125.0, 78.0, "LGA1151 v2"), ("bare", "cpu", None, None, None, None, None, None),
        ("new", "gpu", 2026, 500.0, 480.0, None, 60.0, None), ("lone", "ram", 2023, 100.0, None, None, None, None),
        ("future", "gpu", 2030, 500.0, 480.0, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumn("specs", spec_map({"Socket": text_spec(F.col("socket"))})).drop("socket").cache()


def track(products, product, observations=None):
    rows = price_track(products.filter(F.col("product_id") == product), observations, 2026).orderBy("year", "value").collect()
    return [(r.year, r.value, r.kind) for r in rows]


def test_track_passes_through_both_anchors(spark, products):
    points = track(products, "cpu-5600")
    assert points[0] == (2022, 199.0, "launch") and points[-1] == (2026, 105.0, "current")
    assert [p[2] for p in points[1:-1]] == ["modelled"] * 3 and [p[1] for p in points[1:-1]] == [170.0, 145.0, 123.0]
    summary = price_summary(products, 2026).filter("product_id = 'cpu-5600'").first()
    assert (summary.drop_percent, summary.method) == (47.0, "interpolated")


def test_track_without_anchor_or_span(spark, products):
    assert track(products, "bare") == []
    assert track(products, "new") == [(2026, 480.0, "current"), (2026, 500.0, "launch")]
    assert sorted(track(products, "lone")) == [(2023, 100.0, "launch"), (2024, 88.0, "modelled"), (2025, 77.0, "modelled"), (2026, 68.0, "modelled")]
    assert [p[2] for p in sorted(track(products, "future"))] == ["current", "launch"]


def test_observations_are_points(spark, products):
    seen = spark.sql("SELECT 'cpu-5600' AS product_id, DATE'2024-05-01' AS observed_on, 90.0D AS price, 'note' AS source")
    assert (2024, 90.0, "observed") in track(products, "cpu-5600", seen)


def test_median_of_an_even_count_is_rounded(spark, products):
    found = {r.category: (r.median_score, r.scored) for r in value_median(products).collect()}
    # scores 103, 59, 62 for processors; 13 for the graphics card
    assert found == {"cpu": (62.0, 3), "gpu": (13.0, 1)}
    even = value_median(products.filter("product_id <> 'cpu-9900kf'")).filter("category = 'cpu'").first()
    assert even.median_score == 81.0


def test_verdicts(spark, products):
    found = {r.product_id: r for r in price_insight(products, 2026).collect()}
    codes = lambda p: [x.code for x in found[p].reasons]
    assert (found["bare"].verdict, found["bare"].score) == ("Données insuffisantes", None)
    assert "socket-closed" in codes("cpu-9900kf") and "socket-active" in codes("cpu-7600") and "socket-mature" in codes("cpu-5600")
    assert len(codes("cpu-5600")) >= 3 and "drop-done" in codes("cpu-5600")
    # 50 + 18 (drop) + 16 (value) + 8 (age 4) + 0 (mature socket)
    assert (found["cpu-5600"].score, found["cpu-5600"].verdict, found["cpu-5600"].confidence) == (92.0, "Bon achat aujourd’hui", "Bonne")


def listing(spark, products, **changes):
    values = dict(product_id="cpu-9900kf", price=200.0, shipping=0.0, protection=0.0, condition="good", box=False, invoice=False, warranty=False,
                  tested=True, benchmarks=False, professional=False) | changes
    row = spark.createDataFrame([(1, *values.values())], "listing_id int, product_id string, price double, shipping double, protection double, condition string, box boolean, invoice boolean, warranty boolean, tested boolean, benchmarks boolean, professional boolean")
    return appraise(row, products, 2026).first()


def test_listings(spark, products):
    assert listing(spark, products, shipping=15.0, protection=5.0).total == 220.0
    assert listing(spark, products, condition="excellent").target > listing(spark, products, condition="worn").target
    base = listing(spark, products)
    assert (base.target, base.maximum, base.delta, base.verdict, base.confidence) == (117.0, 129.0, 71.0, "Trop cher", "Moyenne")
    assert listing(spark, products, condition="repair").confidence == "Faible"
    assert listing(spark, products, condition="repair", price=1.0).verdict == "Prix à négocier"
    assert listing(spark, products, product_id="nobody") is None
    none = listing(spark, products, product_id="bare")
    assert (none.verdict, none.target, none.score) == ("Données insuffisantes", None, 0.0)
    assert listing(spark, products, price=-50.0).total == 0.0
