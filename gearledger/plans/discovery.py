"""Discovery: score search hits, find links, read hardware ids, triage, merge, split into lanes, report, promote."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearledger.functions.html import links
from gearledger.functions.identity import candidate_key, promoted_slug
from gearledger.functions.infer import contains_any, device_category
from gearledger.functions.scores import hit_confidence
from gearledger.functions.specs import text_spec
from gearledger.functions.text import fold_text, tokens
from gearledger.functions.urls import canonical, in_domains, link_label, path, resolve
from gearledger.model import inline_table, literal_map
from gearledger.model.dimensions import (
    CATEGORIES, CATEGORY_TERMS, FALSE_POSITIVE_TERMS, FAMILY_TERMS, LANES, RETAIL_PATTERNS, STRONG_FAMILY_PHRASES,
)
from gearledger.operators.ranking import cap_per_group, carry_forward, first_wins
from gearledger.operators.sets import (
    candidate_queue, drop_promoted, flag_known, merge_candidates, only_enabled, overlay, union_feeds,
)
from gearledger.session import cut_lineage

PER_BRAND_CATEGORY = 25
QUEUE_LENGTH = 2500
TO_CHECK = "À vérifier"
OFFICIAL = "manufacturer-index"


def score_hits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Score the hits of registered searches and drop the weak ones.

    ``hits``: query_id, external_id, label, description. ``queries``: query_id, category, brand, query.
    """
    terms = F.create_map(*[x for c, words in CATEGORY_TERMS.items() for x in (F.lit(c), F.array(*[F.lit(w) for w in words]))])
    joined = hits.filter(F.trim("label") != "").join(queries.filter(F.col("category").isin(*CATEGORIES)), "query_id")
    staged = joined.withColumns({
        "_words": tokens(F.concat_ws(" ", "label", "description")),
        "_query": tokens(F.col("query")), "_brand": tokens(F.col("brand")),
    })
    overlap = F.size(F.array_intersect("_query", "_words")) / F.greatest(F.lit(1), F.size("_query"))
    brand, category = F.arrays_overlap("_brand", "_words"), F.arrays_overlap(terms[F.col("category")], F.col("_words"))
    measured = F.struct(overlap.alias("_overlap"), category.alias("_category"), (
        F.when(brand, 0.42).otherwise(0.0) + F.least(F.lit(0.33), overlap * 0.4) + F.when(category, 0.25).otherwise(0.0)
    ).alias("_score"))
    # Weak hits are dropped inside the one-element array: a filter would be pushed down and measure every text again.
    strong = F.filter(F.array(measured), lambda m: (m["_score"] >= 0.42) & (m["_category"] | (m["_overlap"] >= 0.65)))
    kept = staged.select("external_id", "label", "description", "brand", "category", "query", F.inline(strong))
    return kept.select(
        candidate_key(F.lit("wikidata"), F.col("external_id"), F.col("category")).alias("candidate_id"),
        F.lit("wikidata").alias("source_id"), "external_id", F.lit("product-candidate").alias("kind"),
        F.trim("label").alias("label"), F.trim("description").alias("description"), "brand", "category", "query",
        hit_confidence(F.col("_score")).alias("confidence"), F.round("_score", 2).alias("score"),
    )


def discover_links(pages: DataFrame, indexes: DataFrame, limit: int | None = None) -> DataFrame:
    """Product links of stored official index pages.

    ``pages``: index_id, page_no, url, html. ``indexes``: index_id, source_id, brand, category, domains,
    product_patterns, label_patterns, max_candidates, label_segment. An index yields its first ``max_candidates``
    candidates; ``limit`` is an overall quota, filled in the order of the indexes' ids (default: none).
    """
    found = pages.join(indexes, "index_id").select(
        "index_id", "source_id", "brand", "category", "domains", "product_patterns", "label_patterns", "max_candidates",
        "label_segment", "page_no", F.col("url").alias("base"), F.inline(links(F.col("html"))),
    )
    absolute = found.withColumn("url", canonical(resolve(F.col("base"), F.col("href")))).filter(F.col("url").isNotNull())
    labelled = absolute.withColumn("label", link_label(F.col("text"), F.col("url"), F.col("label_segment"))).filter(F.col("label") != "")
    inside = labelled.filter(
        in_domains(F.col("url"), F.col("domains")) & F.exists("product_patterns", lambda p: F.rlike(path(F.col("url")), F.concat(F.lit("(?i)"), p)))
    )
    # The longest label of a page stands for the link; its place is that of its first appearance.
    per_page = inside.groupBy("index_id", "page_no", "url").agg(
        F.max_by("label", F.struct(F.length("label"), -F.col("position"))).alias("label"), F.min("position").alias("position"),
        *[F.first(c).alias(c) for c in ("source_id", "brand", "category", "label_patterns", "max_candidates")],
    )
    wanted = per_page.filter(
        (F.size("label_patterns") == 0) | F.exists("label_patterns", lambda p: F.rlike(F.col("label"), F.concat(F.lit("(?i)"), p)))
    )
    once = first_wins(
        wanted.withColumn("candidate_id", candidate_key(F.col("source_id"), F.col("url"), F.col("category"))),
        ["candidate_id"], ["page_no", "position", "index_id"],
    )
    rank = F.row_number().over(_window(["index_id"], ["page_no", "position"]))
    kept = once.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("max_candidates"))
    if limit is not None:
        kept = kept.orderBy("index_id", "_rank").limit(limit)
    prefixed = F.when(
        F.startswith(fold_text(F.col("label")), fold_text(F.col("brand"))), F.col("label")
    ).otherwise(F.concat_ws(" ", "brand", "label"))
    return kept.select(
        "candidate_id", "source_id", F.col("url").alias("external_id"), F.lit("product-candidate").alias("kind"),
        prefixed.alias("label"), "url", "brand", "category", F.col("index_id").alias("query"), F.lit("Moyenne").alias("confidence"),
        F.lit(0.9).alias("score"),
    )


def _window(keys, order):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


def sitemap_links(locations: DataFrame) -> DataFrame:
    """Canonical links of sitemap locations, labelled by their path. ``locations``: url, position, label_segment."""
    absolute = locations.withColumn("url", canonical(F.trim("url"))).filter(F.col("url").isNotNull())
    return absolute.withColumn("label", link_label(F.lit(""), F.col("url"), F.col("label_segment"))).filter(F.col("label") != "")


def hardware_candidates(lines: DataFrame, vendors: DataFrame, per_group: int = PER_BRAND_CATEGORY, chunk_rows: int = 100_000) -> DataFrame:
    """Device names of registered vendors from a vendor/device text table.

    ``lines``: path, line_no, line. ``vendors``: vendor_id, brand. Every vendor line is carried down, registered or
    not, so that devices of unregistered vendors never fall to the vendor before them.
    """
    body = lines.filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")) & ~F.startswith("line", F.lit("C ")))
    marked = body.withColumn("vendor_id", F.lower(F.nullif(F.regexp_extract("line", "^([0-9a-fA-F]{4})\\s+.+$", 1), F.lit(""))))
    carried = carry_forward(marked, ["vendor_id"], ["path"], "line_no", chunk_rows)
    device = "^\\t([0-9a-fA-F]{4})\\s+(.+)$"
    devices = carried.filter(F.rlike("line", F.lit(device)) & F.col("vendor_id").isNotNull()).select(
        "path", "line_no", "vendor_id", F.lower(F.regexp_extract("line", device, 1)).alias("device_id"),
        F.trim(F.regexp_extract("line", device, 2)).alias("device"),
    )
    placed = F.filter(F.array(device_category(F.col("device"))), lambda c: c.isNotNull())
    known = devices.join(vendors, "vendor_id").select("path", "line_no", "vendor_id", "device_id", "device", "brand", F.explode(placed).alias("category"))
    first = cap_per_group(known, ["brand", "category"], ["path", "line_no"], per_group)
    external = F.concat_ws(":", "vendor_id", "device_id")
    return first.select(
        candidate_key(F.lit("pci-ids"), external, F.col("category")).alias("candidate_id"), F.lit("pci-ids").alias("source_id"),
        external.alias("external_id"), F.lit("hardware-identifier").alias("kind"), F.concat_ws(" ", "brand", "device").alias("label"),
        "brand", "category", F.lit("pci.ids").alias("query"), F.lit("Faible").alias("confidence"), F.lit(0.45).alias("score"),
    )


def triage_class(source: Column, kind: Column, label: Column, description: Column, category: Column) -> Column:
    """First rule that fits, on folded label and description; terms are substrings."""
    folded = lambda words: [_fold(w) for w in words]
    combined = F.concat_ws(" ", label, description)
    retail = reduce(
        lambda a, b: a | b,
        [(category == c) & label.rlike(p) for c, patterns in RETAIL_PATTERNS.items() for p in patterns],
    )
    return (
        F.when((source == "pci-ids") | (kind == "hardware-identifier"), "hardware-identifier")
        .when(contains_any(combined, folded(FALSE_POSITIVE_TERMS)), "false-positive")
        .when(combined.contains("integrated") | combined.contains("integre"), "component-model")
        .when(contains_any(label, folded(FAMILY_TERMS)) | contains_any(description, folded(STRONG_FAMILY_PHRASES)), "product-family")
        .when(retail, "retail-product")
        .when(contains_any(description, folded(FAMILY_TERMS)), "product-family")
        .otherwise("needs-review")
    )


def _fold(word: str) -> str:
    import re
    import unicodedata

    kept = "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")
    return " ".join(re.findall(r"[a-z0-9]+", kept.lower()))


def triage(candidates: DataFrame) -> DataFrame:
    """Add triage class, promotable flag, blocker code and lane."""
    staged = candidates.withColumns({"_label": fold_text(F.col("label"), "NFD"), "_text": fold_text(F.col("description"), "NFD")})
    classed = staged.withColumn("triage", triage_class(
        F.col("source_id"), F.col("kind"), F.col("_label"), F.col("_text"), F.col("category")
    )).drop("_label", "_text")
    retail = F.col("triage") == "retail-product"
    return classed.withColumns({
        "promotable": retail & ~F.col("duplicate"),
        "blocker": F.when(F.col("duplicate"), "duplicate-identity").when(~retail, F.col("triage")),
        "lane": F.coalesce(literal_map(LANES)[F.col("triage")], F.lit("candidates")),
    })


def triage_counts(triaged: DataFrame) -> DataFrame:
    return triaged.groupBy("triage").agg(F.count("*").alias("count"))


def discovery_run(
    previous: DataFrame, discovered: list[DataFrame], identities: DataFrame, sources: DataFrame, promoted: DataFrame,
    run_date: str, limit: int = QUEUE_LENGTH,
) -> DataFrame:
    """Merged, cut and triaged queue with its lanes; promoted candidates leave the candidate lane.

    The feeds of one run follow each other, a later feed is newer.
    """
    fresh = union_feeds(*[feed.withColumn("run_no", F.lit(i).cast("bigint")) for i, feed in enumerate(discovered)])
    if "duplicate" in fresh.columns:
        fresh = fresh.drop("duplicate")
    fresh = flag_known(fresh, identities).withColumns({"status": F.lit(TO_CHECK), "first_seen": F.lit(run_date)})
    merged = merge_candidates(only_enabled(previous, sources), fresh)
    # The queue has a fixed length; it is written once and read for every lane.
    triaged = cut_lineage(triage(candidate_queue(merged, limit)))
    kept = drop_promoted(triaged.filter(F.col("lane") == "candidates"), promoted)
    return kept.unionByName(triaged.filter(F.col("lane") != "candidates"))


def coverage_report(candidates: DataFrame, queries: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per category: registered and observed brands, candidates, official, promotable, ids, rejected."""
    spark = candidates.sparkSession
    official = sources.filter(F.col("enabled") & (F.col("type") == OFFICIAL)).select("source_id", F.lit(True).alias("_official"))
    marked = candidates.join(official, "source_id", "left")
    lane = lambda name: F.col("lane") == name
    counted = marked.groupBy("category").agg(
        F.count_if(lane("candidates")).alias("candidates"),
        F.count_if(lane("candidates") & F.col("_official")).alias("official"),
        F.count_if(lane("candidates") & F.col("promotable")).alias("promotable"),
        F.count_if(lane("identifiers")).alias("identifiers"), F.count_if(lane("rejected")).alias("rejected"),
    )
    brands = lambda df, name: df.select("category", "brand").distinct().groupBy("category").agg(
        F.array_sort(F.collect_list("brand")).alias(name))
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("bigint")
    frame = inline_table(spark, "category string", [(c,) for c in sorted(CATEGORIES)])
    joined = frame.join(brands(queries, "registered_brands"), "category", "left").join(
        brands(candidates, "observed_brands"), "category", "left").join(counted, "category", "left")
    return joined.select(
        "category", F.coalesce("registered_brands", none).alias("registered_brands"),
        F.coalesce("observed_brands", none).alias("observed_brands"),
        *[F.coalesce(c, zero).alias(c) for c in ("candidates", "official", "promotable", "identifiers", "rejected")],
    )


def coverage_totals(candidates: DataFrame, queries: DataFrame, sources: DataFrame) -> DataFrame:
    """One row of totals over the queue and the registry."""
    official = sources.filter(F.col("enabled") & (F.col("type") == OFFICIAL)).select("source_id", F.lit(True).alias("_official"))
    lane = lambda name: F.col("lane") == name
    totals = candidates.join(official, "source_id", "left").agg(
        F.count_if(lane("candidates")).alias("candidates"), F.count_if(lane("candidates") & F.col("_official")).alias("official"),
        F.count_if(lane("identifiers")).alias("identifiers"), F.count_if(lane("rejected")).alias("rejected"),
        F.count_distinct(F.when(F.col("category").isin(*CATEGORIES), F.col("category"))).alias("categories_with_candidates"),
    )
    registry = queries.agg(
        F.count("*").alias("queries"), F.count_distinct("brand").alias("brands"), F.count_distinct("category").alias("categories")
    )
    return totals.withColumns({
        f"registered_{c}": registry.select(c).scalar() for c in ("queries", "brands", "categories")
    })


def collection_status(runs: DataFrame) -> DataFrame:
    """Per run: success without errors, partial when something was read, else failed.

    ``runs``: run_id, requested, succeeded, errors (per request group).
    """
    total = runs.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("requested", "succeeded", "errors")])
    status = F.when(F.col("errors") == 0, "success").when(F.col("succeeded") > 0, "partial").otherwise("failed")
    return total.withColumn("status", status)


def promote(requested: DataFrame, candidates: DataFrame, verifications: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(promoted products, refused requests with code). Code 1 unknown, 2 blocked, 3 not verified.

    ``requested``: candidate_id. ``verifications``: candidate_id, verification, official_url, product struct with
    reference, series, year, specs, notes, usage.
    """
    joined = requested.select("candidate_id").distinct().join(
        candidates.withColumn("_known", F.lit(True)), "candidate_id", "left"
    ).join(verifications, "candidate_id", "left")
    code = (
        F.when(F.col("_known").isNull(), 1).when(~F.coalesce("promotable", F.lit(False)), 2)
        .when(F.coalesce(F.col("verification") != "verified", F.lit(True)), 3)
    )
    judged = joined.withColumn("refusal", code)
    extra = F.create_map(
        F.lit("Identifiant découverte"), text_spec(F.col("external_id")), F.lit("Source découverte"), text_spec(F.col("source_id"))
    )
    specs = F.map_zip_with(F.col("product.specs"), extra, lambda _k, old, new: F.coalesce(new, old))
    promoted = judged.filter(F.col("refusal").isNull()).select(
        promoted_slug(F.col("label"), F.col("source_id"), F.col("external_id")).alias("product_id"), "candidate_id", "category", "brand",
        F.col("label").alias("name"), "product.reference", "product.series", "product.year",
        F.lit(None).cast("double").alias("new_price"), F.lit(None).cast("double").alias("used_price"),
        F.lit("Bonne").alias("confidence"), F.lit("Documentaire").alias("status"), "product.notes", "product.usage",
        specs.alias("specs"), F.col("official_url").alias("source"),
    )
    refused = judged.filter(F.col("refusal").isNotNull()).select("candidate_id", "refusal", F.coalesce("blocker", F.lit("")).alias("blocker"))
    return promoted, refused


def promote_into(catalogue: DataFrame, promoted: DataFrame) -> DataFrame:
    """Promoted products replace stored ones of the same id, in category, brand, name order."""
    return overlay(catalogue, promoted, ["product_id"]).orderBy("category", F.lower("brand"), F.lower("name"))


def review_queue(candidates: DataFrame, verifications: DataFrame, evidence: DataFrame, specs: DataFrame) -> DataFrame:
    """Candidates with what is known about each: verification, evidence and number of specifications."""
    counted = specs.groupBy("candidate_id").agg(F.count("*").alias("n_specs"))
    return candidates.join(verifications.select("candidate_id", "verification"), "candidate_id", "left").join(
        evidence.select("candidate_id", F.col("status").alias("evidence"), F.col("score").alias("match_score")), "candidate_id", "left"
    ).join(counted, "candidate_id", "left").withColumn("n_specs", F.coalesce("n_specs", F.lit(0).cast("bigint")))


def review_kpis(candidates: DataFrame, verifications: DataFrame, promoted: DataFrame) -> DataFrame:
    """Verified, integrated and pending counts of the review."""
    states = candidates.join(verifications.select("candidate_id", "verification"), "candidate_id", "left").join(
        promoted.select("candidate_id", F.lit(True).alias("integrated")), "candidate_id", "left"
    )
    return states.agg(
        F.count_if(F.col("verification") == "verified").alias("verified"), F.count_if(F.col("integrated")).alias("integrated"),
        F.count_if(F.col("verification").isNull() & F.col("integrated").isNull()).alias("pending"),
    )
