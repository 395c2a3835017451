"""Keys and identity expressions: codes, hashes, slugs, candidate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gearledger.functions.specs import json_text
from gearledger.functions.text import fold_text, normalize_identifier, slugify, strip_accents

# The specification keys that tell variants of one product name apart, in this order.
DISCRIMINATORS = ("capacity", "memory", "modules", "wattage", "socket", "chipset", "form_factor", "screen_size")


def codes(part_numbers: Column, brand: Column, gtin: Column, ean: Column, upc: Column) -> Column:
    """Ordered ``array<struct<rank,type,value,scope>>``. Part numbers are scoped to the brand.

    Codes of fewer than four characters are too weak to identify anything and are dropped.
    """
    def code(kind: str, value: Column, scope: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), normalize_identifier(value).alias("value"), scope.alias("scope"))

    scope = fold_text(brand)
    mpns = F.transform(F.coalesce(part_numbers, F.array().cast("array<string>")), lambda v: code("mpn", v, scope))
    world = F.array(code("gtin", gtin, F.lit("")), code("ean", ean, F.lit("")), code("upc", upc, F.lit("")))
    kept = F.filter(F.concat(mpns, world), lambda c: F.length(c["value"]) >= 4)
    return F.transform(
        kept, lambda c, i: F.struct(i.alias("rank"), c["type"].alias("type"), c["value"].alias("value"), c["scope"].alias("scope"))
    )


def identity_hash(brand: Column, name: Column, category: Column, specs: Column) -> Column:
    """SHA-256 over folded brand and name, category and the discriminating specifications."""
    parts = [F.concat(F.lit(f"{key}:"), json_text(specs[key])) for key in DISCRIMINATORS]
    return F.sha2(F.concat_ws("|", fold_text(brand), fold_text(name), category, *parts), 256)


def candidate_key(source: Column, external: Column, category: Column) -> Column:
    return F.concat(F.lit("candidate-"), F.substring(F.sha1(F.concat_ws(":", source, external, category)), 1, 16))


def suffixed_slug(name: Column, seed: Column) -> Column:
    """Slug of a name followed by eight hex digits of a stable seed."""
    return F.concat(slugify(name), F.lit("-"), F.substring(F.sha1(seed), 1, 8))


def _dashed(text: Column, limit: int, form: str) -> Column:
    lowered = F.lower(strip_accents(text, form))
    return F.substring(F.btrim(F.regexp_replace(lowered, "[^a-z0-9]+", "-"), F.lit("-")), 1, limit)


def document_slug(value: Column) -> Column:
    """Id of a product read from an outline. Characters outside ASCII vanish instead of splitting words."""
    ascii_only = F.regexp_replace(strip_accents(value, "NFKD"), "[^\\x00-\\x7F]", "")
    return F.concat(F.lit("doc-"), _dashed(ascii_only, 58, "NFKD"), F.lit("-"), F.substring(F.sha1(value), 1, 8))


def promoted_slug(label: Column, source: Column, external: Column) -> Column:
    digest = F.substring(F.sha1(F.concat_ws(":", source, external)), 1, 8)
    return F.concat(F.lit("open-"), _dashed(label, 55, "NFD"), F.lit("-"), digest)


def record_id(source: Column, record: Column) -> Column:
    """Deterministic component id from the natural key, so that a replay writes the same id."""
    return F.sha2(F.concat_ws("|", source, record), 256)
