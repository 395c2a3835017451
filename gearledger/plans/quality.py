"""Quality gate: every rule is a selection of ``(rule, subject)`` rows; an empty result lets the tables pass.

Tables are given by name; rules of tables that are not given are left out. Keyed rules are joins or counts per
key, so nothing depends on the number of rows fitting anywhere.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from gearledger.functions.urls import in_domains
from gearledger.model import inline_table
from gearledger.model import spec_dictionary as dictionary
from gearledger.model.dimensions import CATEGORIES, EVIDENCE_STATUSES, VERIFICATION_STATUSES
from gearledger.operators.sets import same_set
from gearledger.plans.discovery import OFFICIAL, TO_CHECK, coverage_report, coverage_totals
from gearledger.plans.evidence import evidence_summary
from gearledger.plans.specs import missing_fields, spec_summary

# Bounds of the collection policy (column, lowest, highest).
POLICY_BOUNDS = (
    ("search_page_size", 1, 50), ("search_max_pages", 1, 2), ("index_page_budget", 1, 50), ("index_candidate_limit", 1, 1000),
    ("evidence_page_budget", 1, 50), ("evidence_property_limit", 1, 100), ("spec_page_budget", 1, 50), ("spec_field_limit", 1, 200),
)
LANE_CLASSES = {
    "candidates": ("retail-product", "product-family", "component-model", "needs-review"),
    "identifiers": ("hardware-identifier",),
    "rejected": ("false-positive",),
}
LOCAL_PATH = "[A-Za-z]:\\\\|/Users/|/home/"
ISO_DATE = "^\\d{4}-\\d{2}-\\d{2}$"


@F.pandas_udf(BooleanType())
def compilable(patterns: pd.Series) -> pd.Series:
    """Whether a registered pattern is a valid expression."""
    import re

    def check(pattern):
        try:
            re.compile(pattern)
            return True
        except (re.error, TypeError):
            return False

    return patterns.map(check)


def _flag(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One pass over a table for all its row rules; a rule without an answer counts as broken."""
    # Bounds may be scalar sub-queries, which a higher-order function cannot hold: the misses are dropped after the explode.
    broken = F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()])
    listed = df.select(F.col(key).cast("string").alias("subject"), broken.alias("_broken"))
    return listed.select(F.explode("_broken").alias("rule"), "subject").filter(F.col("rule").isNotNull())


def _repeated(df: DataFrame, key: list[str], rule: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(
        F.lit(rule).alias("rule"), F.concat_ws(":", *key).alias("subject")
    )


def _orphans(child: DataFrame, parent: DataFrame, key: str, rule: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("subject"))


def _differs(actual: DataFrame, expected: DataFrame, keys: list[str], columns: list[str], rule: str) -> DataFrame:
    """Key values whose columns differ between a stored report and the recomputed one."""
    joined = actual.select(*keys, F.struct(*columns).alias("_a")).join(expected.select(*keys, F.struct(*columns).alias("_b")), keys, "full_outer")
    return joined.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(F.lit(rule).alias("rule"), F.concat_ws(":", *keys).alias("subject"))


def _trusted(df: DataFrame, domains: DataFrame, brand: str) -> DataFrame:
    listed = domains.groupBy(F.col("brand").alias("_brand")).agg(F.collect_set("domain").alias("_domains"))
    joined = df.join(listed, F.col(brand) == F.col("_brand"), "left").drop("_brand")
    return joined.withColumn("_domains", F.coalesce("_domains", F.array().cast("array<string>")))


def _policy(t: dict) -> list[DataFrame]:
    policy = t["policy"]
    rules = {"publication-enabled": F.coalesce(F.col("publish_automatically"), F.lit(True))}
    for column, low, high in POLICY_BOUNDS:
        rules[f"policy-bound:{column}"] = ~F.col(column).between(low, high)
    if "queries" in t:
        count = t["queries"].select(F.count("*").alias("n")).scalar()
        rules["request-budget-too-small"] = F.col("request_budget") < count * F.col("search_max_pages")
    return [_flag(policy.withColumn("policy_id", F.lit("policy")), "policy_id", rules)]


def _queries(t: dict) -> list[DataFrame]:
    queries = t["queries"].withColumn("pair", F.concat_ws(":", "category", "brand"))
    return [
        _repeated(queries, ["category", "brand"], "duplicate-query"),
        _flag(queries, "pair", {"invalid-query": ~(F.col("category").isin(*CATEGORIES) & (F.col("brand") != "") & (F.col("query") != ""))}),
    ]


def _products(t: dict) -> list[DataFrame]:
    priced = F.col("new_price").isNotNull() | F.col("used_price").isNotNull()
    unknown = ~F.col("category").isin(*CATEGORIES)
    found, ids = [], []
    if "documentary" in t:
        found.append(_flag(t["documentary"], "product_id", {"invalid-category": unknown, "documentary-price": priced}))
        ids.append(t["documentary"].select("product_id"))
    if "promoted" in t:
        promoted = t["promoted"]
        found.append(_flag(promoted, "product_id", {
            "invalid-promoted": unknown | (F.col("status") != "Documentaire"), "promoted-price": priced,
            "promoted-source": ~F.startswith(F.coalesce("source", F.lit("")), F.lit("https://")),
        }))
        ids.append(promoted.select("product_id"))
        if "verifications" in t:
            proof = t["verifications"].select("candidate_id", "verification", "official_url")
            joined = promoted.join(proof, "candidate_id", "left")
            proven = F.coalesce(F.col("verification") == "verified", F.lit(False))
            found.append(_flag(joined, "product_id", {
                "promoted-without-proof": ~proven,
                "promoted-source-mismatch": proven & ~F.col("source").eqNullSafe(F.col("official_url")),
            }))
    if ids:
        found.append(_repeated(reduce(lambda a, b: a.unionByName(b), ids), ["product_id"], "duplicate-product"))
    return found


def _indexes(t: dict) -> list[DataFrame]:
    indexes, sources = t["indexes"], t["sources"].filter("enabled")
    joined = indexes.join(sources.select(
        "source_id", "type", F.col("url").alias("source_url"), "robots_url", "robots_checked_at", "allow_missing_robots"), "source_id", "left")
    trusted = _trusted(joined, t["domains"], "brand")
    rules = {
        "index-without-id": F.coalesce("index_id", F.lit("")) == "",
        "index-source": ~(F.coalesce(F.col("type") == OFFICIAL, F.lit(False)) & in_domains(F.col("source_url"), F.col("domains"))),
        "index-robots": F.col("robots_url").isNull() & F.col("robots_checked_at").isNull(),
        "index-robots-date": F.coalesce("allow_missing_robots", F.lit(False)) & F.col("robots_checked_at").isNull(),
        "index-format": ~F.coalesce("format", F.lit("html")).isin("html", "sitemap"),
        "index-target": ~(F.col("category").isin(*CATEGORIES) & (F.col("brand") != "")),
        "index-domain": F.size(F.array_except("domains", "_domains")) > 0,
    }
    patterns = indexes.select("index_id", F.explode("patterns").alias("pattern")).filter(~compilable("pattern"))
    return [
        _flag(trusted, "index_id", rules), _repeated(indexes, ["index_id"], "duplicate-index"),
        patterns.select(F.lit("index-pattern").alias("rule"), F.col("index_id").alias("subject")).distinct(),
    ]


def _candidates(t: dict) -> list[DataFrame]:
    candidates = t["candidates"]
    enabled = t["sources"].filter("enabled").select("source_id", F.col("type").alias("_type"))
    # Texts are read where they lie: sources and brands are few, so joins by them move and crowd only what their rules need.
    texts = F.concat_ws("\n", *[c for c, k in candidates.dtypes if k == "string"])
    short = candidates.select(
        "candidate_id", "source_id", "category", "brand", "url", "status", "triage", "lane", "duplicate", "promotable",
        texts.rlike(LOCAL_PATH).alias("_local"), (F.coalesce("triage_reason", F.lit("")) == "").alias("_unreasoned"),
        (F.coalesce("blocker", F.lit("")) == "").alias("_unblocked"))
    joined = _trusted(short.join(enabled, "source_id", "left"), t["domains"], "brand")
    retail = (F.col("triage") == "retail-product") & ~F.col("duplicate")
    lane_ok = reduce(lambda a, b: a | b, [(F.col("lane") == lane) & F.col("triage").isin(*kinds) for lane, kinds in LANE_CLASSES.items()])
    official = F.coalesce(F.col("_type") == OFFICIAL, F.lit(False))
    return [
        _repeated(candidates, ["candidate_id"], "duplicate-candidate"),
        _flag(joined, "candidate_id", {
            "candidate-category": ~F.col("category").isin(*CATEGORIES),
            "candidate-source": F.col("_type").isNull(),
            "candidate-url": ~F.startswith(F.coalesce("url", F.lit("")), F.lit("https://")),
            "local-path": F.col("_local"),
            "auto-published": F.coalesce(F.col("status") != TO_CHECK, F.lit(True)),
            "wrong-lane": ~lane_ok,
            "promotion-flag": F.col("promotable") != retail,
            "triage-reason": F.col("_unreasoned"),
            "promotion-blocker": ~retail & F.col("_unblocked"),
            "official-domain": official & ~in_domains(F.col("url"), F.col("_domains")),
            "identifier-source": (F.col("lane") == "identifiers") & (F.col("source_id") != "pci-ids"),
        }),
    ]


def _reports(t: dict) -> list[DataFrame]:
    found = []
    candidates, queries, sources = t.get("candidates"), t.get("queries"), t.get("sources")
    ready = candidates is not None and queries is not None and sources is not None
    if "coverage" in t and ready:
        stored = t["coverage"]
        names = inline_table(stored.sparkSession, "category string", [(c,) for c in CATEGORIES])
        found += [
            same_set(stored, names, "category").select(F.lit("coverage-categories").alias("rule"), F.col("category").alias("subject")),
            _repeated(stored, ["category"], "coverage-repeated"),
            _differs(stored, coverage_report(candidates, queries, sources), ["category"],
                     ["registered_brands", "candidates", "official", "identifiers"], "stale-coverage"),
        ]
    if "coverage_totals" in t and ready:
        columns = ["registered_queries", "registered_brands", "registered_categories", "candidates", "official", "identifiers", "rejected"]
        key = F.lit("totals").alias("report")
        found.append(_differs(t["coverage_totals"].select(key, *columns), coverage_totals(candidates, queries, sources).select(key, *columns),
                              ["report"], columns, "stale-totals"))
    if "collection" in t and "policy" in t:
        policy = t["policy"]
        found.append(_flag(t["collection"], "run_id", {
            "collection-status": ~F.col("status").isin("not-run", "success", "partial", "failed"),
            "collection-budget": F.col("requested") > policy.select("request_budget").scalar(),
        }))
    return found


def _verifications(t: dict) -> list[DataFrame]:
    proofs = t["verifications"]
    subjects = t["candidates"].select("candidate_id", F.col("brand").alias("_subject_brand"), F.lit(0).alias("_o"))
    if "promoted" in t:
        subjects = subjects.unionByName(t["promoted"].select("candidate_id", F.col("brand").alias("_subject_brand"), F.lit(1).alias("_o")))
    subjects = subjects.groupBy("candidate_id").agg(F.max_by("_subject_brand", "_o").alias("_subject_brand"))
    joined = _trusted(proofs.join(subjects, "candidate_id", "left"), t["domains"], "manufacturer")
    verified = F.col("verification") == "verified"
    return [
        _repeated(proofs, ["candidate_id"], "duplicate-verification"),
        _orphans(proofs, subjects, "candidate_id", "orphan-verification"),
        _flag(joined, "candidate_id", {
            "manufacturer-mismatch": ~F.col("_subject_brand").eqNullSafe(F.col("manufacturer")),
            "verification-status": ~F.col("verification").isin(*VERIFICATION_STATUSES),
            "verification-url": ~(F.startswith("official_url", F.lit("https://")) & in_domains(F.col("official_url"), F.col("_domains"))),
            "verified-without-product": verified & ~F.col("has_product"),
            "blocked-with-product": ~verified & F.col("has_product"),
        }),
    ]


def official_candidates(t: dict) -> DataFrame:
    official = t["sources"].filter(F.col("enabled") & (F.col("type") == OFFICIAL)).select("source_id")
    return t["candidates"].filter(F.col("lane") == "candidates").join(official, "source_id", "left_semi")


def _subject_rules(joined: DataFrame, prefix: str) -> dict[str, Column]:
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    return {
        f"{prefix}-subject": ~(same("source_id", "c_source") & same("official_url", "c_url")),
        f"{prefix}-classification": ~(same("brand", "c_brand") & same("category", "c_category")),
    }


def _with_subject(df: DataFrame, t: dict) -> DataFrame:
    subject = official_candidates(t).select(
        "candidate_id", F.col("source_id").alias("c_source"), F.col("url").alias("c_url"), F.col("brand").alias("c_brand"), F.col("category").alias("c_category")
    )
    return df.join(subject, "candidate_id")


def _failures(failures: DataFrame, resolved: DataFrame, t: dict, prefix: str) -> list[DataFrame]:
    return [
        _orphans(failures, official_candidates(t), "candidate_id", f"orphan-{prefix}-failure"),
        _repeated(failures, ["candidate_id"], f"duplicate-{prefix}-failure"),
        failures.join(resolved.select("candidate_id"), "candidate_id", "left_semi").select(F.lit(f"resolved-{prefix}-failure").alias("rule"), F.col("candidate_id").alias("subject")),
        _flag(failures, "candidate_id", {f"invalid-{prefix}-failure": ~((F.col("attempts") >= 1) & (F.col("error") != ""))}),
    ]


def _evidence(t: dict) -> list[DataFrame]:
    evidence, policy = t["evidence"], t["policy"]
    joined = _trusted(_with_subject(evidence, t), t["domains"], "c_brand")
    found = [
        _orphans(evidence, official_candidates(t), "candidate_id", "orphan-evidence"),
        _repeated(evidence, ["candidate_id"], "duplicate-evidence"),
        _flag(joined, "candidate_id", {
            **_subject_rules(joined, "evidence"),
            "evidence-status": ~F.col("status").isin(*EVIDENCE_STATUSES),
            "evidence-review": ~((F.col("review_status") == "pending") & (F.col("review_reason") != "")),
            "evidence-identity": ~F.forall(F.map_values("identity"), lambda v: v.isNotNull()),
            "evidence-properties": (F.size("properties") > policy.select("evidence_property_limit").scalar())
            | ~F.forall("properties", lambda p: p["name"].isNotNull() & p["value"].isNotNull()),
            "evidence-match": ~(F.col("score").between(0, 1) & F.col("signals").isNotNull()),
            "evidence-canonical": ~(F.startswith("canonical_url", F.lit("https://")) & in_domains(F.col("canonical_url"), F.col("_domains"))),
        }),
    ]
    if "evidence_failures" in t:
        found += _failures(t["evidence_failures"], evidence, t, "evidence")
        failed = t["evidence_failures"].join(official_candidates(t).select("candidate_id"), "candidate_id", "left_semi")
        if "evidence_summary" in t:
            expected = evidence_summary(official_candidates(t), evidence, failed)
            found.append(_differs(t["evidence_summary"], expected, ["name"], ["value"], "stale-evidence-summary"))
    if "evidence_run" in t:
        found.append(_flag(t["evidence_run"], "run_id", {"evidence-budget": F.col("page_limit") > policy.select("evidence_page_budget").scalar()}))
    return found


def _specs(t: dict) -> list[DataFrame]:
    records, values, policy = t["spec_records"], t["spec_values"], t["policy"]
    spark = records.sparkSession
    joined = _with_subject(records, t)
    texts = F.concat_ws("\n", *[c for c, k in records.dtypes if k == "string"])
    methods = list(dictionary.METHODS)
    declared = inline_table(spark, "category string, position int, field string, d_label string, d_unit string, expression string, prose boolean", dictionary.field_rows())
    typed = values.join(records.select("candidate_id", "category"), "candidate_id").join(F.broadcast(declared), ["category", "field"], "left")
    checked = _trusted(_with_subject(typed, t), t["domains"], "c_brand")
    counts = values.groupBy("candidate_id").agg(F.count_distinct("field").alias("n"))
    missing = missing_fields(records, values).select("candidate_id", F.col("missing").alias("_missing"))
    recounted = records.join(counts, "candidate_id", "left").join(missing, "candidate_id")
    found = [
        _orphans(records, official_candidates(t), "candidate_id", "orphan-specification"),
        _orphans(records, t["evidence"], "candidate_id", "specification-without-evidence"),
        _repeated(records, ["candidate_id"], "duplicate-specification"),
        _flag(joined, "candidate_id", {
            **_subject_rules(joined, "specification"),
            "specification-category": ~F.col("category").isin(*dictionary.CATEGORIES),
            "specification-date": ~F.rlike("collected_at", F.lit(ISO_DATE)),
            "specification-review": ~((F.col("review_status") == "pending") & (F.col("review_reason") != "")),
            "claims-verification": texts.contains("verified"),
            "raw-rows": (F.size("raw_rows") > policy.select("spec_field_limit").scalar())
            | ~F.forall("raw_rows", lambda r: r["field"].isNotNull() & r["value"].isNotNull() & r["method"].isin(*methods)),
        }),
        _repeated(values, ["candidate_id", "field"], "duplicate-field"),
        _flag(checked.withColumn("at", F.concat_ws(":", "candidate_id", "field")), "at", {
            "unknown-field": F.col("d_label").isNull(),
            "stale-label": ~F.coalesce(F.col("label") == F.col("d_label"), F.col("d_label").isNull()),
            "empty-value": F.coalesce("shown", F.lit("")) == "",
            "no-raw-evidence": ~((F.col("raw_field") != "") & (F.col("raw_value") != "")),
            "method-or-confidence": ~(F.col("method").isin(*methods) & F.col("confidence").isin(*dictionary.CONFIDENCES)),
            "prose-allow-list": (F.col("method") == "meta") & ~(F.coalesce("prose", F.lit(False)) & (F.col("confidence") == "low")),
            "value-date": ~F.rlike("collected_at", F.lit(ISO_DATE)),
            "value-source": ~(F.col("source_url").eqNullSafe(F.col("c_url")) & F.startswith("source_url", F.lit("https://"))
                              & in_domains(F.col("source_url"), F.col("_domains"))),
        }),
        _flag(recounted, "candidate_id", {
            "missing-fields": ~F.col("missing").eqNullSafe(F.col("_missing")),
            "specification-coverage": ~((F.col("coverage_raw") == F.size("raw_rows")) & (F.col("coverage_normalized") == F.coalesce("n", F.lit(0)))),
        }),
    ]
    if "spec_failures" in t:
        found += _failures(t["spec_failures"], records, t, "specification")
    if "spec_summary" in t:
        raw = records.select("candidate_id", F.explode("raw_rows").alias("r"))
        found.append(_differs(t["spec_summary"], spec_summary(records, values.join(records.select("candidate_id", "category"), "candidate_id"), raw),
                              ["section", "name"], ["records", "values"], "stale-specification-summary"))
    if "spec_run" in t:
        found.append(_flag(t["spec_run"], "run_id", {
            "specification-budget": F.col("page_limit") > policy.select("spec_page_budget").scalar(),
            "specification-published": F.coalesce("publish_automatically", F.lit(True)),
        }))
    return found


_GROUPS = (
    (("policy",), _policy), (("queries",), _queries), ((), _products), (("indexes", "sources", "domains"), _indexes),
    (("candidates", "sources", "domains"), _candidates), ((), _reports), (("verifications", "candidates", "domains"), _verifications),
    (("evidence", "candidates", "sources", "domains", "policy"), _evidence),
    (("spec_records", "spec_values", "evidence", "candidates", "sources", "domains", "policy"), _specs),
)


def validate(tables: dict[str, DataFrame]) -> DataFrame:
    """All violations of the given tables."""
    parts = [part for needs, rules in _GROUPS if all(n in tables for n in needs) for part in rules(tables)]
    if not parts:
        raise ValueError("no table to validate")
    return reduce(lambda a, b: a.unionByName(b), parts)
