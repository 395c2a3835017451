"""Tagged specification values: ``STRUCT<kind, s, n, b, a>`` held in a map keyed by field name.

``kind`` is one of text, number, boolean, list, json, null. Typed accessors return null on another kind,
so a rule can never read a text as a figure.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPEC = "struct<kind:string,s:string,n:double,b:boolean,a:array<string>>"
SPEC_MAP = f"map<string,{SPEC}>"


def _spec(kind: str, s=None, n=None, b=None, a=None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"),
        (none if s is None else s).cast("string").alias("s"),
        (none if n is None else n).cast("double").alias("n"),
        (none if b is None else b).cast("boolean").alias("b"),
        (none if a is None else a).cast("array<string>").alias("a"),
    )


def text_spec(value: Column) -> Column:
    return F.when(value.isNotNull(), _spec("text", s=value))


def number_spec(value: Column) -> Column:
    return F.when(value.isNotNull(), _spec("number", n=value))


def boolean_spec(value: Column) -> Column:
    return F.when(value.isNotNull(), _spec("boolean", b=value))


def list_spec(value: Column) -> Column:
    return F.when(value.isNotNull(), _spec("list", a=value))


def spec_map(entries: dict[str, Column]) -> Column:
    """Map of the given values; entries that are null are left out."""
    pairs = F.array(*[F.struct(F.lit(key).alias("key"), value.alias("value")) for key, value in entries.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def from_variant(value: Column) -> Column:
    """Tag a VARIANT value; arrays of plain strings become lists, other nested values keep their JSON text."""
    kind = F.schema_of_variant(value)
    texts = F.try_variant_get(value, "$", "array<string>")
    scalars = F.try_variant_get(value, "$", "array<variant>")
    all_text = F.forall(scalars, lambda v: F.schema_of_variant(v) == "STRING")
    return (
        F.when(value.isNull() | (kind == "VOID"), _spec("null"))
        .when(kind == "STRING", _spec("text", s=F.try_variant_get(value, "$", "string")))
        .when(kind == "BOOLEAN", _spec("boolean", b=F.try_variant_get(value, "$", "boolean")))
        .when(kind.startswith("ARRAY") & all_text, _spec("list", a=texts))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), _spec("json", s=F.to_json(value)))
        .otherwise(_spec("number", n=F.try_variant_get(value, "$", "double")))
    )


def text_of(specs: Column, key: str) -> Column:
    entry = specs[key]
    return F.when(entry["kind"] == "text", entry["s"])


def number_of(specs: Column, key: str) -> Column:
    entry = specs[key]
    return F.when(entry["kind"] == "number", entry["n"])


def list_of(specs: Column, key: str) -> Column:
    entry = specs[key]
    return F.when(entry["kind"] == "list", entry["a"])


def number_text(value: Column) -> Column:
    """A double printed the way JSON prints it: no trailing ``.0`` on whole numbers."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def display(spec: Column, missing: str = "À vérifier") -> Column:
    """Readable form; an absent value shows the sentinel instead of vanishing."""
    shown = (
        F.when(spec["kind"] == "list", F.array_join(spec["a"], ", "))
        .when(spec["kind"] == "number", number_text(spec["n"]))
        .when(spec["kind"] == "boolean", spec["b"].cast("string"))
        .when(spec["kind"].isin("text", "json"), spec["s"])
    )
    return F.coalesce(shown, F.lit(missing))


def flat_text(spec: Column) -> Column:
    """The value as search text; lists are joined with a comma, absent values give an empty string."""
    return F.when(spec.isNull() | (spec["kind"] == "null"), F.lit("")).otherwise(
        F.when(spec["kind"] == "list", F.array_join(spec["a"], ",")).otherwise(display(spec, ""))
    )


def json_text(spec: Column) -> Column:
    """Canonical JSON of one value, ``null`` when absent."""
    quoted = F.to_json(F.array(spec["s"]))
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return F.coalesce(
        F.when(spec["kind"] == "text", quoted)
        .when(spec["kind"] == "number", number_text(spec["n"]))
        .when(spec["kind"] == "boolean", spec["b"].cast("string"))
        .when(spec["kind"] == "list", F.to_json(spec["a"]))
        .when(spec["kind"] == "json", spec["s"]),
        F.lit("null"),
    )
