"""Page evidence: identity, properties and match score of a product page, for human review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearledger.functions import html as page
from gearledger.functions.text import clean_markup, tokens
from gearledger.functions.urls import in_domains, resolve
from gearledger.model import inline_table
from gearledger.model.dimensions import EVIDENCE_STATUSES, GENERIC_TOKENS, IDENTITY_FIELDS
from gearledger.operators.markup import ld_objects


def identity_match(label: Column, title: Column, brand: Column, signals: int = 12) -> Column:
    """``struct<score, signals>``: best of Dice and containment over the words that carry identity, and the ``signals`` longest shared words."""
    generic = F.array(*[F.lit(t) for t in GENERIC_TOKENS])
    ignored = F.concat(generic, tokens(brand))

    def compare(words: Column) -> Column:
        left, right, shared = words["left"], words["right"], words["shared"]
        both = F.size(shared).cast("double")
        dice = 2 * both / (F.size(left) + F.size(right))
        containment = both / F.least(F.size(left), F.size(right))
        longest_first = F.array_sort(F.transform(shared, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
        shown = F.slice(F.transform(longest_first, lambda x: x["w"]), 1, signals)
        known = (F.size(left) > 0) & (F.size(right) > 0)
        return F.struct(
            F.when(known, F.round(F.greatest(dice, containment), 2)).otherwise(F.lit(0.0)).alias("score"),
            F.when(known, shown).otherwise(F.array().cast("array<string>")).alias("signals"),
        )

    pair = F.struct(F.array_except(tokens(label), ignored).alias("left"), F.array_except(tokens(title), ignored).alias("right"))
    shared = page.let(pair, lambda p: F.struct(
        p["left"].alias("left"), p["right"].alias("right"), F.array_intersect(p["left"], p["right"]).alias("shared")))
    return page.let(shared, compare)


def _is_product(node: Column) -> Column:
    raw = F.try_variant_get(node, "$['@type']", "variant")
    names = F.when(
        F.schema_of_variant(raw).startswith("ARRAY"), F.try_variant_get(raw, "$", "array<string>")
    ).otherwise(F.array(F.try_variant_get(raw, "$", "string")))
    return F.exists(names, lambda t: F.lower(F.regexp_extract(t, "([^/]*)$", 1)).isin("product", "productmodel"))


def parse_pages(pages: DataFrame, key: str = "url", property_limit: int | None = None, text_limit: int | None = None) -> DataFrame:
    """Title, description, canonical link, identity and properties of every page.

    ``pages`` keeps its columns, including the unique ``key``, ``url`` and ``html``; the html itself is dropped. The product is the first one with
    a name in document order, at any depth of the JSON-LD, else the first one. Without limits all properties and whole texts are kept.
    """
    html = F.col("html")
    nodes = ld_objects(pages, key).withColumn("v", F.try_parse_json("node")).filter(F.coalesce(_is_product(F.col("v")), F.lit(False)))
    unnamed = page.first_text(F.try_variant_get("v", "$.name", "variant")) == ""
    chosen = nodes.groupBy(key).agg(F.min_by("node", F.struct(unnamed.alias("unnamed"), "document", "at")).alias("_node"))
    # Each reading of the page is a column of its own, so that it is done once however often it is used.
    found = pages.withColumns({
        "_metas": page.meta_map(html), "_link": page.canonical_href(html), "_h1": page.first_heading(html), "_title": page.title(html),
    }).drop("html").join(chosen, key, "left").withColumn("_product", F.try_parse_json("_node"))
    product = F.col("_product")

    def cut(text: Column) -> Column:
        return text if text_limit is None else F.substring(text, 1, text_limit)

    def value(name: str) -> Column:
        return cut(page.first_text(F.try_variant_get(product, f"$.{name}", "variant")))

    brand = F.coalesce(F.nullif(value("brand"), F.lit("")), value("manufacturer"))
    entries = F.array(*[
        F.struct(F.lit(n).alias("key"), v.alias("value"))
        for n, v in [(n, value(n)) for n in IDENTITY_FIELDS] + [("brand", brand)]
    ])
    identity = F.map_from_entries(F.filter(entries, lambda e: F.coalesce(e["value"] != "", F.lit(False))))
    metas = F.col("_metas")
    filled = lambda o: page.let(o, lambda v: F.nullif(v, F.lit("")))
    first = lambda *options: F.coalesce(*[filled(o) for o in options], F.lit(""))
    title = first(value("name"), clean_markup(metas["og:title"]), clean_markup(metas["twitter:title"]), F.col("_h1"), F.col("_title"))
    description = first(value("description"), clean_markup(metas["og:description"]), clean_markup(metas["description"]))
    properties = F.transform(page.node_properties(product), lambda p: F.struct(
        cut(clean_markup(page.property_name(p))).alias("name"), cut(clean_markup(page.property_value(p))).alias("value"),
    ))
    kept = F.array_distinct(F.filter(properties, lambda p: (p["name"] != "") & (p["value"] != "")))
    kept = kept if property_limit is None else F.slice(kept, 1, property_limit)
    return found.select(
        *[c for c in pages.columns if c != "html"], cut(title).alias("page_title"), cut(description).alias("page_description"),
        F.when(F.col("_link").isNotNull(), resolve(F.col("url"), F.col("_link"))).otherwise(F.col("url")).alias("canonical_url"),
        F.when(product.isNotNull(), identity).otherwise(F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))).alias("identity"),
        F.coalesce(kept, F.array().cast("array<struct<name:string,value:string>>")).alias("properties"),
        product.isNotNull().alias("structured"),
    )


def page_evidence(pages: DataFrame, candidates: DataFrame, domains: DataFrame, checked_at: str) -> DataFrame:
    """Evidence of every candidate whose page is stored.

    ``pages``: url (unique), html. ``candidates``: candidate_id, source_id, category, brand, label, url. ``domains``: brand, domain.
    Pages are parsed before the join, so each is read once even when several candidates share it.
    """
    parsed = parse_pages(pages.select("url", "html"))
    listed = domains.groupBy("brand").agg(F.collect_set("domain").alias("_domains"))
    joined = candidates.join(parsed, "url").join(listed, "brand", "left")
    allowed = in_domains(F.col("canonical_url"), F.coalesce("_domains", F.array().cast("array<string>")))
    scored = joined.withColumn("match", identity_match(F.col("label"), F.col("page_title"), F.col("brand")))
    status = (
        F.when(F.col("structured"), "structured-product")
        .when((F.col("page_title") != "") & (F.col("match.score") >= 0.35), "page-metadata").otherwise("insufficient-metadata")
    )
    return scored.select(
        "candidate_id", "source_id", "category", "brand", F.col("url").alias("official_url"), F.lit(checked_at).alias("checked_at"),
        status.alias("status"), "identity", "page_title", "page_description",
        F.when(allowed, F.col("canonical_url")).otherwise(F.col("url")).alias("canonical_url"), "properties",
        F.col("match.score").alias("score"), F.col("match.signals").alias("signals"), F.lit("pending").alias("review_status"),
    )


def evidence_summary(active: DataFrame, evidence: DataFrame, failures: DataFrame) -> DataFrame:
    """Rows ``(name, value)``: official candidates, collected, remaining, failures and every status, zeros included."""
    spark = active.sparkSession
    counts = evidence.groupBy("status").agg(F.count("*").alias("value"))
    statuses = inline_table(spark, "status string", [(s,) for s in EVIDENCE_STATUSES])
    by_status = statuses.join(counts, "status", "left").select(
        F.concat(F.lit("status:"), F.col("status")).alias("name"), F.coalesce("value", F.lit(0).cast("bigint")).alias("value")
    )
    n = lambda df: df.select(F.count("*").alias("n")).scalar()
    totals = spark.range(1).select(F.inline(F.array(
        F.struct(F.lit("official").alias("name"), n(active).alias("value")),
        F.struct(F.lit("collected").alias("name"), n(evidence).alias("value")),
        F.struct(F.lit("remaining").alias("name"), (n(active) - n(evidence)).alias("value")),
        F.struct(F.lit("failures").alias("name"), n(failures).alias("value")),
    )))
    return totals.unionByName(by_status)
