"""Schemas and fixed dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value) if isinstance(value, int) else f"{value!r}D"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def inline_table(spark: SparkSession, schema: str, rows) -> DataFrame:
    """A fixed dimension as a local relation, so its size is known to the planner."""
    fields = [part.strip().split(" ", 1) for part in schema.split(",")] if "<" not in schema else None
    if fields is None:
        raise ValueError("inline tables hold scalar and array<string> columns given as 'name array'")
    names = ", ".join(name for name, _ in fields)
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    return table.select(
        *[F.col(name) if kind == "array" else F.col(name).cast(kind).alias(name) for name, kind in fields]
    )


def literal_map(values: dict):
    """A fixed lookup as a map literal, for tables small enough to live inside an expression."""
    flat = [F.lit(item) for pair in values.items() for item in pair]
    return F.create_map(*flat)
