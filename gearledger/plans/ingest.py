"""Catalogue ingestion: resolve, merge field by field, score, write.

Tables of a catalogue
---------------------
``components``      one merged row per component
``fields``          (component_id, key, value, source, priority, confidence, arrival): the provenance
``sources``         source records with the component they feed
``identifiers``     (component_id, type, value, scope)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gearledger.functions import scores
from gearledger.functions.specs import SPEC_MAP, boolean_spec, spec_map, text_spec
from gearledger.functions.text import fold_text
from gearledger.operators.ranking import first_wins, latest, with_position
from gearledger.operators.resolution import BEFORE_BATCH, resolve_rows
from gearledger.operators.survivorship import SPEC_PREFIX, survive, union_part_numbers
from gearledger.session import Scratch

TABLES = ("components", "fields", "sources", "identifiers")


@dataclass
class CatalogTables:
    components: DataFrame
    fields: DataFrame
    sources: DataFrame
    identifiers: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}


def incoming_fields(records: DataFrame) -> DataFrame:
    """Field rows of resolved records: scalar fields plus one row per specification."""
    texts = ("subcategory", "brand", "manufacturer", "model", "series", "name", "mpn", "gtin", "ean", "upc", "description", "short_description")
    scalars: dict[str, Column] = {name: text_spec(F.col(name)) for name in texts}
    scalars["release_date"] = text_spec(F.col("release_date").cast("string"))
    scalars["discontinued"] = boolean_spec(F.col("discontinued"))
    media = F.to_json(F.struct(F.col("media_main").alias("main"), F.col("media_gallery").alias("gallery")), {"ignoreNullFields": "false"})
    scalars["media"] = F.struct(
        F.lit("json").alias("kind"), media.alias("s"), F.lit(None).cast("double").alias("n"),
        F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("array<string>").alias("a"),
    )
    specs = F.transform_keys("specs", lambda k, _v: F.concat(F.lit(SPEC_PREFIX), k))
    both = F.map_concat(spec_map(scalars).cast(SPEC_MAP), specs.cast(SPEC_MAP))
    return records.select(
        "component_id", F.explode(both).alias("key", "value"), F.col("source_key").alias("source"), "priority",
        F.col("source_confidence").alias("confidence"), "arrival",
    )


def assemble(fields: DataFrame) -> DataFrame:
    """Wide merged columns of each component from its surviving fields."""
    def scalar(name: str) -> Column:
        return F.max(F.when(F.col("key") == name, F.col("value.s"))).alias(name)

    texts = ("subcategory", "brand", "manufacturer", "model", "series", "name", "mpn", "gtin", "ean", "upc", "description", "short_description", "media")
    is_spec = F.col("key").startswith(SPEC_PREFIX)
    pair = F.struct(F.substring("key", len(SPEC_PREFIX) + 1, 2**31 - 1).alias("key"), "value")
    wide = fields.groupBy("component_id").agg(
        *[scalar(t) for t in texts],
        F.max(F.when(F.col("key") == "release_date", F.col("value.s"))).cast("date").alias("release_date"),
        F.coalesce(F.bool_or(F.when(F.col("key") == "discontinued", F.col("value.b"))), F.lit(False)).alias("discontinued"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(is_spec, pair)))).alias("specs"),
    )
    return wide.withColumns({
        "media_main": F.get_json_object("media", "$.main"),
        "media_gallery": F.coalesce(F.from_json(F.get_json_object("media", "$.gallery"), "array<string>"), F.array().cast("array<string>")),
    }).drop("media")


def with_components(records: DataFrame, catalog: CatalogTables | None, scratch: Scratch) -> DataFrame:
    """The records of a batch as a table, numbered in reading order (``arrival``), with the component each feeds and whether it founds it.

    They are written first: sampling their order would read and normalise them all a second time. Only what orders and resolves them is
    numbered and moved; a whole record moves once, to its component.
    """
    stored = scratch.cut(records.withColumn("_line", F.monotonically_increasing_id()))
    order = scratch.cut(with_position(stored.select("read_order", "record_id", "_line"), ["read_order", "record_id"], "arrival", cut=scratch.cut).select("_line", "arrival"))
    keys = stored.select("_line", "record_id", "source_key", "source_record_id", "category", "identity_hash", "codes").join(order, "_line")
    assigned = resolve_rows(
        keys, catalog.sources if catalog else None, catalog.identifiers if catalog else None, catalog.components if catalog else None, scratch)
    batch = scratch.cut(stored.join(order.join(assigned.drop("record_id"), "arrival"), "_line").drop("_line"))
    scratch.drop(stored, order, assigned)
    return batch


#: What makes a row of each table the same one: a change replaces all rows of its keys.
KEYS = {
    "components": ("component_id",), "fields": ("component_id",), "sources": ("source_key", "source_record_id"), "identifiers": ("component_id",),
}


def ingest(records: DataFrame, catalog: CatalogTables | None, seen_at: str) -> tuple[CatalogTables, DataFrame]:
    """Take a batch of canonical records into the catalogue: the new tables and one outcome row per record (created or updated).

    The tables are plans over the old ones; nothing is stored.
    """
    changed, outcomes = changes(records, catalog, seen_at)
    return overlaid(catalog, changed), outcomes


def overlaid(catalog: CatalogTables | None, changed: CatalogTables) -> CatalogTables:
    """The tables with all rows of the changed keys replaced."""
    if catalog is None:
        return changed
    return CatalogTables(**{
        name: table.join(getattr(changed, name).select(*KEYS[name]).distinct(), list(KEYS[name]), "left_anti").unionByName(getattr(changed, name))
        for name, table in catalog.as_dict().items()
    })


def changes(records: DataFrame, catalog: CatalogTables | None, seen_at: str, scratch: Scratch | None = None) -> tuple[CatalogTables, DataFrame]:
    """What a batch of canonical records changes: for every table all new rows of each touched key (see ``KEYS``), and one outcome row per record.

    Tables written on the way belong to ``scratch``; the results read them.
    """
    scratch = scratch or Scratch(records.sparkSession)
    batch = with_components(records, catalog, scratch)
    touched = batch.select("component_id").distinct()
    fields = incoming_fields(batch)
    if catalog:
        stored = catalog.fields.withColumn("arrival", F.lit(BEFORE_BATCH).cast("bigint"))
        fields = fields.unionByName(stored.join(touched, "component_id", "left_semi"))
    merged_fields = scratch.cut(survive(fields))

    numbers = batch.select("component_id", "arrival", "part_numbers")
    founders = batch.filter("created").select(
        "component_id", "category", "slug", "identity_hash", F.col("source_key").alias("primary_source"),
    )
    fresh = batch.groupBy("component_id").agg(
        F.max("completeness").alias("new_completeness"), F.max("confidence").alias("new_confidence"),
        F.max_by("search_document", "arrival").alias("last_document"), F.count("*").alias("n"),
        F.bool_or("created").alias("founded"),
        F.min_by("needs_review", "arrival").alias("first_review"), F.min_by("search_document", "arrival").alias("first_document"),
    )
    if catalog:
        old = catalog.components.join(touched, "component_id", "left_semi")
        numbers = numbers.unionByName(old.select("component_id", F.lit(BEFORE_BATCH).cast("bigint").alias("arrival"), "part_numbers"))
        founders = founders.unionByName(old.select("component_id", "category", "slug", "identity_hash", "primary_source"))
        scores_before = old.select("component_id", F.col("completeness").alias("old_completeness"), F.col("confidence").alias("old_confidence"))
    else:
        scores_before = founders.select("component_id", F.lit(None).cast("int").alias("old_completeness"), F.lit(None).cast("int").alias("old_confidence"))

    merged = (
        founders.join(assemble(merged_fields), "component_id").join(fresh, "component_id")
        .join(union_part_numbers(numbers), "component_id", "left").join(scores_before, "component_id", "left")
    )
    part_numbers = F.coalesce("part_numbers", F.array().cast("array<string>"))
    count = F.size("specs")
    # A component fed by one record keeps that record's own flag; merging recomputes it.
    single = F.col("founded") & (F.col("n") == 1)
    document = fold_text(F.concat_ws(" ", "last_document", "name", "brand", F.array_join(part_numbers, " ")))
    components = merged.select(
        "component_id", "category", "subcategory", "brand", "manufacturer", "model", "series", "name", "slug", "mpn",
        part_numbers.alias("part_numbers"), "gtin", "ean", "upc", "description", "short_description", "release_date",
        "discontinued", "media_main", "media_gallery", "specs", "primary_source", "identity_hash",
        F.greatest("old_completeness", "new_completeness").alias("completeness"),
        F.greatest("old_confidence", "new_confidence").alias("confidence"),
        F.col("media_main").isNull().alias("missing_image"), (F.size(part_numbers) == 0).alias("missing_mpn"),
        (count == 0).alias("missing_specs"),
        F.when(single, F.col("first_review")).otherwise(scores.needs_review(part_numbers, count)).alias("needs_review"),
        F.when(single, F.col("first_document")).otherwise(document).alias("search_document"),
    )
    new_sources = latest(batch.select(
        "source_key", "source_record_id", "component_id", "source_url", "source_license",
        F.col("priority").alias("source_priority"), "source_confidence", "raw", "arrival",
    ), ["source_key", "source_record_id"], ["arrival"]).drop("arrival").withColumns({"first_seen": F.lit(seen_at), "last_seen": F.lit(seen_at)})
    codes = batch.select("component_id", F.explode("codes").alias("c")).select("component_id", "c.type", "c.value", "c.scope").distinct()
    outcomes = batch.select(
        "source_key", F.col("arrival").alias("read_no"), "record_id", "source_record_id", "category", "component_id",
        F.when(F.col("created"), "created").otherwise("updated").alias("outcome"), F.lit(None).cast("string").alias("message"),
    )
    if catalog is not None:
        keys = ["source_key", "source_record_id"]
        seen = catalog.sources.select(*keys, F.col("first_seen").alias("_first"))
        new_sources = new_sources.join(seen, keys, "left").withColumn("first_seen", F.coalesce("_first", "first_seen")).drop("_first")
        known = catalog.identifiers.join(codes.select("component_id").distinct(), "component_id", "left_semi")
        codes = codes.unionByName(known).distinct()
    return CatalogTables(components, merged_fields, new_sources, codes), outcomes


def dry_run(records: DataFrame, catalog: CatalogTables | None, seen_at: str) -> dict[str, int]:
    """What taking a batch would do, counted on the real plan: read, created, updated, and rows each table would get. Nothing is left in any folder.

    The figures are metrics that the plans report while they run into nowhere, so each plan runs once.
    """
    spark = records.sparkSession
    found: dict[str, int] = {}
    with Scratch(spark) as scratch:
        changed, outcomes = changes(records, catalog, seen_at, scratch)
        kind = lambda k: F.count_if(F.col("outcome") == k).alias(k)
        plans = {"outcomes": (outcomes, [F.count(F.lit(1)).alias("read"), kind("created"), kind("updated")])}
        plans |= {name: (table, [F.count(F.lit(1)).alias(name)]) for name, table in changed.as_dict().items()}
        for name, (plan, metrics) in plans.items():
            seen = Observation(name)
            plan.observe(seen, *metrics).write.format("noop").mode("overwrite").save()
            found |= seen.get
    return found


def repeatable(records: DataFrame) -> DataFrame:
    """Exact repeats of a source record inside a batch are taken once, the first in reading order."""
    return first_wins(records, ["source_key", "source_record_id"], ["read_order", "record_id"])


def sync(spark: SparkSession, waves: list[DataFrame], catalog: CatalogTables | None, seen_at: str) -> tuple[CatalogTables, DataFrame]:
    """Waves of sources one after the other (curated, open database, export), each on what the former left.

    A wave writes what it changes and its outcomes; the tables are plans over what the waves wrote. Everything else goes with the wave.
    """
    outcomes = None
    for wave in waves:
        with Scratch(spark) as scratch:
            changed, done = changes(wave, catalog, seen_at, scratch)
            changed = CatalogTables(**{n: scratch.keep(t) for n, t in changed.as_dict().items()})
            done = scratch.keep(done)
        catalog = overlaid(catalog, changed)
        outcomes = done if outcomes is None else outcomes.unionByName(done)
    return catalog, outcomes
