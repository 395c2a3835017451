"""Specification extraction from stored pages and normalisation of the raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearledger.functions.html import acceptable, property_rows, prose_rows
from gearledger.functions.spec_fields import parse_field
from gearledger.functions.text import plain, squeeze
from gearledger.functions.urls import in_domains
from gearledger.model import inline_table
from gearledger.model import spec_dictionary as dictionary
from gearledger.operators.markup import layout_rows, ld_objects, page_tasks
from gearledger.operators.ranking import cap_per_group
from gearledger.session import tasks_for

#: Raw rows that one task matches and parses.
ROWS = 1 << 16


def extract_specs(pages: DataFrame, key: str = "page_id", limit: int | None = None, name_limit: int | None = None, value_limit: int | None = None) -> DataFrame:
    """Raw rows of every page: (key, row_no, field, value, method), repeats removed; JSON-LD first, then the layout, then the description.

    Without limits every row is kept. ``limit`` keeps the first rows of a page, ``name_limit`` and ``value_limit`` drop rows with longer names
    or values (a description is cut). The key must be unique.
    """
    long = F.lit(0).cast("bigint")
    tasks = page_tasks(pages)
    told = ld_objects(pages, key, tasks).select(key, "document", "at", F.try_parse_json("node").alias("v")).select(
        key, "document", "at", F.posexplode(property_rows(F.col("v"))).alias("nth", "r"))
    told = told.select(key, F.struct(F.lit(0).alias("part"), F.col("document").cast("bigint").alias("a"), F.col("at").cast("bigint").alias("b"), "nth").alias("order"), "r.*")
    laid = layout_rows(pages, key, tasks)
    laid = laid.select(key, F.struct(F.lit(1).alias("part"), F.col("close").cast("bigint").alias("a"), long.alias("b"), "nth").alias("order"), "field", "value", "method")
    prose = pages.select(key, F.posexplode(prose_rows(F.col("html"))).alias("nth", "r"))
    prose = prose.select(key, F.struct(F.lit(2).alias("part"), long.alias("a"), long.alias("b"), "nth").alias("order"), "r.*")
    if value_limit is not None:
        prose = prose.withColumn("value", F.substring("value", 1, value_limit))
    rows = told.unionByName(laid).unionByName(prose).filter(acceptable(F.col("field"), F.col("value"), F.col("method")))
    for column, most in (("field", name_limit), ("value", value_limit)):
        if most is not None:
            rows = rows.filter(F.length(column) <= most)
    # By page, as the numbering needs them: one shuffle for both.
    unique = rows.repartition(tasks, key).groupBy(key, "method", F.lower("field").alias("_f"), F.lower("value").alias("_v")).agg(
        F.min(F.struct("order", "field", "value")).alias("r"))
    numbered = unique.withColumn("row_no", F.row_number().over(Window.partitionBy(key).orderBy("r.order")) - 1)
    found = numbered.select(key, "row_no", "r.field", "r.value", "method")
    return found if limit is None else cap_per_group(found, [key], ["row_no"], limit)


def field_key(name: Column) -> Column:
    return F.array_join(F.regexp_extract_all(plain(name), F.lit("[a-z0-9+./-]+"), F.lit(0)), " ")


def word_ngrams(key: Column, longest: int) -> Column:
    """All runs of up to ``longest`` consecutive letter-digit groups with the separators between them."""
    def grams(more: int) -> Column:
        pattern = f"(?=((?<![a-z0-9])[a-z0-9]+(?:[^a-z0-9]+[a-z0-9]+){{{more}}}(?![a-z0-9])))"
        return F.regexp_extract_all(key, F.lit(pattern), F.lit(1))

    return F.array_distinct(F.concat(*[grams(i) for i in range(longest)]))


def match_fields(raw: DataFrame) -> DataFrame:
    """Raw rows with every dictionary field their name stands for.

    A whole-word alias is found by equality on the word n-grams of the name; the dictionary has a fixed size.
    Prose rows feed the allow-listed fields only.
    """
    spark = raw.sparkSession
    aliases = F.broadcast(inline_table(
        spark, "category string, position int, target string, label string, unit string, expression string, alias string, whole_name boolean",
        dictionary.alias_rows(),
    ))
    prose = F.broadcast(inline_table(
        spark, "category string, position int, target string, label string, unit string, expression string, prose boolean",
        dictionary.field_rows(),
    ).filter("prose").drop("prose"))
    known = raw.filter(F.col("method").isin(*dictionary.METHODS)).withColumn("_key", field_key(F.col("field")))
    named = known.filter(F.col("method") != "meta").withColumn(
        "alias", F.explode(word_ngrams(F.col("_key"), dictionary.longest_alias()))
    ).join(aliases, ["category", "alias"]).filter(~F.col("whole_name") | (F.col("alias") == F.col("_key")))
    named = named.drop("alias", "whole_name").distinct()
    told = known.filter(F.col("method") == "meta").join(prose, "category")
    return named.unionByName(told).drop("_key")


def _rank_of(values, column: str) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))


def normalize_specs(raw: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Best typed value of each field of each record.

    ``raw``: key, category, row_no, field, value, method. The same call rebuilds everything offline from stored rows.
    """
    # All rows of a record lie together from here on, whatever files they come from.
    rows = raw.select(key, "category", "row_no", "field", "value", "method")
    matched = match_fields(rows.repartition(tasks_for(rows, ROWS), key))
    # The folded text is a column of its own, so it is computed once per row and not once per pattern. Generating
    # the hit from a one-element array drops misses without evaluating the expression a second time as a filter.
    hit = parse_field(F.col("expression"), F.col("_text"))
    staged = matched.withColumn("_text", plain(F.col("value")))
    parsed = staged.select(*matched.columns, F.explode(F.filter(F.array(hit), lambda h: h.isNotNull())).alias("hit"))
    confidence = F.when(F.col("method") == "meta", "low").when(F.col("hit.exact"), "high").otherwise("medium")
    graded = parsed.withColumn("confidence", confidence)
    order = F.struct(_rank_of(dictionary.CONFIDENCES, "confidence"), _rank_of(dictionary.METHODS, "method"), F.col("row_no"))
    entry = F.struct(
        "label", F.substring(squeeze(F.col("field")), 1, 120).alias("raw_field"), F.substring(squeeze(F.col("value")), 1, 240).alias("raw_value"),
        F.col("hit.spec").alias("spec"), "unit", "method", "confidence", "position",
    )
    best = graded.groupBy(key, "category", F.col("target").alias("field")).agg(F.min_by(entry, order).alias("e"))
    return best.select(key, "category", "field", "e.*")


def missing_fields(records: DataFrame, specs: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Declared fields a record does not publish, in declaration order. ``records``: key, category."""
    declared = F.create_map(*[
        x for c, fields in dictionary.FIELDS.items() for x in (F.lit(c), F.array(*[F.lit(f[0]) for f in fields]))
    ])
    resolved = specs.groupBy(key).agg(F.collect_set("field").alias("_resolved"))
    joined = records.select(key, "category").join(resolved, key, "left")
    none = F.array().cast("array<string>")
    return joined.select(
        key, "category", F.array_except(F.coalesce(declared[F.col("category")], none), F.coalesce("_resolved", none)).alias("missing")
    )


def eligible(candidates: DataFrame, evidence: DataFrame, sources: DataFrame, domains: DataFrame) -> DataFrame:
    """Candidates worth reading: reachable page, official source, supported category, maker's own domain.

    ``domains``: brand, domain.
    """
    reachable = evidence.filter(F.col("status").isin("structured-product", "page-metadata")).select("candidate_id")
    official = sources.filter(F.col("enabled") & (F.col("type") == "manufacturer-index")).select("source_id")
    kept = candidates.filter(F.col("category").isin(*dictionary.CATEGORIES)).join(reachable, "candidate_id", "left_semi").join(
        official, "source_id", "left_semi"
    )
    return trusted(kept, domains)


def trusted(candidates: DataFrame, domains: DataFrame) -> DataFrame:
    """Rows whose URL host is a domain of their brand or below one."""
    listed = domains.groupBy("brand").agg(F.collect_set("domain").alias("_domains"))
    return candidates.join(listed, "brand").filter(in_domains(F.col("url"), F.col("_domains"))).drop("_domains")


def spec_summary(records: DataFrame, specs: DataFrame, raw: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Rows ``(section, name, records, values)``: totals, every category and every confidence level, zeros included."""
    spark = records.sparkSession
    names = inline_table(
        spark, "section string, name string",
        [("category", c) for c in dictionary.CATEGORIES] + [("confidence", c) for c in dictionary.CONFIDENCES] + [("total", "normalized"), ("total", "raw")],
    )
    counted = records.groupBy(F.col("category").alias("name")).agg(F.count("*").alias("records")).withColumn("section", F.lit("category"))
    parts = [
        specs.groupBy(F.col("category").alias("name")).agg(F.count("*").alias("values")).withColumn("section", F.lit("category")),
        specs.groupBy(F.col("confidence").alias("name")).agg(F.count("*").alias("values")).withColumn("section", F.lit("confidence")),
        specs.agg(F.count("*").alias("values")).withColumns({"section": F.lit("total"), "name": F.lit("normalized")}),
        raw.agg(F.count("*").alias("values")).withColumns({"section": F.lit("total"), "name": F.lit("raw")}),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    zero = F.lit(0).cast("bigint")
    return names.join(found, ["section", "name"], "left").join(counted, ["section", "name"], "left").select(
        "section", "name", F.coalesce("records", zero).alias("records"), F.coalesce("values", zero).alias("values")
    )


def fresh_counts(records: DataFrame, specs: DataFrame, raw: DataFrame, run_date: str, key: str = "candidate_id") -> DataFrame:
    """What a run added: records, raw and normalised values collected on ``run_date``."""
    fresh = records.filter(F.col("collected_at") == run_date).select(key)
    count = lambda df, name: df.join(fresh, key, "left_semi").agg(F.count("*").alias(name))
    return fresh.agg(F.count("*").alias("collected")).withColumns({
        "raw_values": count(raw, "n").scalar(), "normalized_values": count(specs, "n").scalar(),
    })
