"""Field-level survivorship with provenance.

Fields are rows ``(component_id, key, value, source, priority, confidence, arrival)``. The winner of a field is
the usable value of the highest priority, the later arrival among equals: one ``max_by`` with map-side
combination, no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scalar fields of a component that are merged one by one.
SCALAR_FIELDS = (
    "subcategory", "brand", "manufacturer", "model", "series", "name", "mpn", "gtin", "ean", "upc", "description",
    "short_description", "release_date", "discontinued", "media",
)
SPEC_PREFIX = "specifications."


def usable(value: Column) -> Column:
    """Text that is present; specification values that are not JSON null."""
    return F.coalesce(value["kind"] != "null", F.lit(False)) & F.coalesce(
        (value["kind"] != "text") | (value["s"] != ""), F.lit(False)
    )


def survive(fields: DataFrame) -> DataFrame:
    """Winning value of each (component_id, key) with the provenance it came from."""
    winner = F.max_by(F.struct("value", "source", "priority", "confidence", "arrival"), F.struct("priority", "arrival"))
    return fields.filter(usable(F.col("value"))).groupBy("component_id", "key").agg(winner.alias("w")).select(
        "component_id", "key", "w.*"
    )


def union_part_numbers(numbers: DataFrame) -> DataFrame:
    """Distinct part numbers of each component in order of first appearance.

    ``numbers``: component_id, arrival, part_numbers. Repeats are removed before anything is gathered.
    """
    rows = numbers.select("component_id", "arrival", F.posexplode("part_numbers").alias("at", "number"))
    first = rows.groupBy("component_id", "number").agg(F.min(F.struct("arrival", "at")).alias("seen"))
    return first.groupBy("component_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seen", "number"))), lambda x: x["number"]).alias("part_numbers")
    )
