"""Quality gate over tables that break some of its rules, and the streaming counters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gearledger.catalogue_queries.shapes import pick, plain_sql, shape, table
from gearledger.operators.ranking import first_wins
from gearledger.plans.quality import validate
from gearledger.session import ensure_checkpoint_dir
from gearledger.streaming.imports import counters, counters_to_table, file_stream, next_collection

NINE = ("cpu", "gpu", "motherboard", "ram", "psu", "case", "storage", "cooling", "expansion")
QUERIES_ROWS = f"SELECT {pick('o_custkey', *NINE, 'fridge')} AS category, CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'Brand ' || CAST(o_orderkey % 800 AS STRING) END AS brand, 'q' AS query FROM {{orders}}"
SOURCES = "SELECT 'src' || CAST(n_nationkey AS STRING) AS source_id, n_regionkey <> 2 AS enabled, CASE WHEN n_nationkey % 2 = 0 THEN 'manufacturer-index' ELSE 'open' END AS type, 'https://www.' || lower(n_name) || '.example/x' AS url, CASE WHEN n_nationkey % 5 > 0 THEN 'https://r' END AS robots_url, CASE WHEN n_nationkey % 5 = 0 AND n_nationkey > 5 THEN '2024-01-01' END AS robots_checked_at, n_nationkey % 5 = 0 AS allow_missing_robots FROM {nation}"
DOMAINS = "SELECT 'Maker ' || l.lang AS brand, l.lang || '.example.com' AS domain FROM (SELECT DISTINCT lang FROM {documents}) l"
POLICY = """SELECT count(*) > 0 AS publish_automatically, CAST(max(r_regionkey) * 20 AS INT) AS search_page_size, 2 AS search_max_pages, 60 AS request_budget, 30 AS index_page_budget, 500 AS index_candidate_limit,
  20 AS evidence_page_budget, 2 AS evidence_property_limit, 20 AS spec_page_budget, 3 AS spec_field_limit FROM {region}"""
INDEXES = """SELECT 'index ' || CAST(n_nationkey % 20 AS STRING) AS index_id, 'src' || CAST(n_nationkey AS STRING) AS source_id, lower(n_name) || '.example' AS domain, CASE WHEN n_nationkey % 6 = 0 THEN 'pdf' ELSE 'html' END AS format,
  CASE WHEN n_nationkey % 7 = 0 THEN 'fridge' ELSE 'gpu' END AS category, 'Maker ' || n_name AS brand, CASE WHEN n_nationkey % 8 = 0 THEN '([' ELSE '^/p' END AS pattern FROM {nation}"""
INDEX_DOMAINS = "SELECT 'Maker ' || n_name AS brand, lower(n_name) || '.example' AS domain FROM {nation} WHERE n_nationkey % 3 > 0"
PRODUCTS = f"SELECT CAST(p_partkey % 1900 AS STRING) AS product_id, {pick('p_size', *NINE, 'fridge')} AS category, CASE WHEN p_size % 7 = 0 THEN p_retailprice END AS new_price, CASE WHEN p_size % 23 = 0 THEN 1.5 END AS used_price FROM {{part}}"
PROMOTED = f"SELECT 'open-' || CAST(s_suppkey AS STRING) AS product_id, CAST(s_suppkey AS STRING) AS candidate_id, {pick('s_nationkey', *NINE, 'fridge')} AS category, CASE WHEN s_nationkey = 3 THEN 'Détaillée' ELSE 'Documentaire' END AS status, CASE WHEN s_nationkey = 4 THEN s_acctbal END AS new_price, CAST(NULL AS DOUBLE) AS used_price, CASE WHEN s_nationkey = 5 THEN NULL ELSE 'https://m.example/' || CAST(s_suppkey % 3 AS STRING) END AS source, 'Maker en' AS brand FROM {{supplier}}"
PROOFS = """SELECT CAST(doc_id % 120 AS STRING) AS candidate_id, CASE doc_id % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'maybe' ELSE 'verified' END AS verification, CASE WHEN doc_id % 6 = 0 THEN 'Maker fr' ELSE 'Maker en' END AS manufacturer,
  'https://' || CASE WHEN doc_id % 5 = 0 THEN 'bad.example' ELSE 'en.example.com' END || '/' || CAST(doc_id % 3 AS STRING) AS official_url, doc_id % 7 > 0 AS has_product FROM {labels}"""
CANDIDATES = f"""SELECT CAST(doc_id AS STRING) AS candidate_id, source AS source_id, {pick('doc_id', *NINE, 'fridge')} AS category, 'Maker ' || lang AS brand,
  CASE WHEN doc_id % 13 = 0 THEN 'http' ELSE 'https' END || '://' || CASE WHEN doc_id % 3 = 0 THEN 'x.' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN 'de' ELSE lang END || '.example.com/p' AS url, text AS description,
  CASE WHEN doc_id % 31 = 0 THEN 'Publié' WHEN doc_id % 37 = 0 THEN '/home/x' ELSE 'À vérifier' END AS status,
  {pick('doc_id', 'retail-product', 'product-family', 'hardware-identifier', 'false-positive', 'needs-review')} AS triage,
  {pick('doc_id', 'candidates', 'candidates', 'identifiers', 'rejected', 'rejected')} AS lane, doc_id % 11 = 0 AS duplicate, doc_id % 5 = 0 AS promotable,
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'reason' END AS triage_reason, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE 'blocker' END AS blocker FROM {{documents}}"""


def _policy(spark, folder):
    return shape(spark, folder, POLICY)


def q_quality_registry(spark, folder):
    """Policy, registered searches and index registry."""
    indexes = shape(spark, folder, INDEXES)
    return validate({
        "policy": _policy(spark, folder), "queries": shape(spark, folder, QUERIES_ROWS), "sources": shape(spark, folder, SOURCES),
        "domains": shape(spark, folder, INDEX_DOMAINS),
        "indexes": indexes.select("index_id", "source_id", F.array("domain").alias("domains"), "format", "category", "brand", F.array("pattern").alias("patterns")),
    })


def q_quality_products(spark, folder):
    return validate({
        "documentary": shape(spark, folder, PRODUCTS), "promoted": shape(spark, folder, PROMOTED),
        "verifications": first_wins(shape(spark, folder, PROOFS), ["candidate_id"], ["official_url", "verification", "manufacturer", "has_product"]),
    })


def q_quality_candidates(spark, folder):
    return validate({"candidates": shape(spark, folder, CANDIDATES), "sources": shape(spark, folder, SOURCES), "domains": shape(spark, folder, DOMAINS)})


def q_quality_verifications(spark, folder):
    return validate({
        "candidates": shape(spark, folder, CANDIDATES), "domains": shape(spark, folder, DOMAINS), "verifications": shape(spark, folder, PROOFS),
    })


def _evidence(spark, folder):
    """One evidence row per given page, for the candidate of the same number."""
    rows = shape(spark, folder, """SELECT CAST(page_id AS STRING) AS candidate_id, CASE WHEN page_id % 5 = 0 THEN 'approved' ELSE 'pending' END AS review_status, 'reason' AS review_reason,
      CASE WHEN page_id % 7 = 0 THEN 'done' ELSE 'page-metadata' END AS status, CASE WHEN page_id % 11 = 0 THEN 1.5 ELSE 0.5 END AS score, page_id % 4 AS n, page_id FROM {pages}""")
    subject = shape(spark, folder, CANDIDATES).select("candidate_id", "source_id", F.col("url").alias("official_url"), "brand", "category")
    joined = rows.join(subject, "candidate_id")
    pair = F.struct(F.lit("name").alias("name"), F.lit("value").alias("value"))
    return joined.select(
        "candidate_id", "source_id", F.when(F.col("page_id") % 9 == 0, "https://other").otherwise(F.col("official_url")).alias("official_url"), "brand", "category", "status",
        "review_status", "review_reason", F.create_map(F.lit("name"), F.lit("x")).alias("identity"), F.array_repeat(pair, F.col("n").cast("int")).alias("properties"),
        F.col("score").cast("double").alias("score"), F.array(F.lit("a")).alias("signals"), F.col("official_url").alias("canonical_url"))


def q_quality_evidence(spark, folder):
    found = validate({
        "policy": _policy(spark, folder), "candidates": shape(spark, folder, CANDIDATES), "sources": shape(spark, folder, SOURCES), "domains": shape(spark, folder, DOMAINS),
        "evidence": _evidence(spark, folder),
    })
    return found.filter(F.col("rule").contains("evidence"))


def q_stream_counters(spark, folder):
    """Events read as a file stream: rows per kind and user group."""
    schema = table(spark, folder, "events").schema
    stream = file_stream(spark, folder, schema, pattern="events.parquet").select(
        F.col("event_type").alias("source_key"), (F.col("user_id") % 7).alias("category"))
    place = f"{ensure_checkpoint_dir(spark)}/counters-{uuid.uuid4().hex}"
    counters_to_table(stream, f"{place}/table", f"{place}/state").awaitTermination()
    return counters(spark, f"{place}/table")


def q_next_collection(spark, folder):
    """The next 150 candidates to read: open, least tried, sources in turn."""
    queue = shape(spark, folder, "SELECT o_orderkey AS candidate_id, o_orderpriority AS source_id FROM {orders}")
    done = shape(spark, folder, "SELECT DISTINCT l_orderkey AS candidate_id FROM {lineitem} WHERE l_returnflag = 'A'")
    ledger = shape(spark, folder, "SELECT o_orderkey AS candidate_id, o_custkey % 4 AS attempts FROM {orders} WHERE o_orderstatus = 'F'")
    return next_collection(queue, done, ledger, 150)


_OK_CATEGORY = "category IN ('" + "', '".join(NINE) + "')"


def _rules(source: str, key: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, CAST({key} AS VARCHAR) AS subject FROM {source} WHERE {bad}" for rule, bad in rules.items())


_POLICY_BOUNDS = {"search_page_size": (1, 50), "search_max_pages": (1, 2), "index_page_budget": (1, 50), "index_candidate_limit": (1, 1000),
                  "evidence_page_budget": (1, 50), "evidence_property_limit": (1, 100), "spec_page_budget": (1, 50), "spec_field_limit": (1, 200)}
_UNDER = lambda url, domain: f"(regexp_extract({url}, '//([^/]*)', 1) = {domain} OR ends_with(regexp_extract({url}, '//([^/]*)', 1), '.' || {domain}))"
REGISTRY_SQL = f"""WITH p AS ({plain_sql(POLICY)}), q AS ({plain_sql(QUERIES_ROWS)}), s AS ({plain_sql(SOURCES)}), i0 AS ({plain_sql(INDEXES)}), d AS ({plain_sql(INDEX_DOMAINS)}),
  i AS (SELECT i0.*, s.type, s.url, s.robots_url, s.robots_checked_at, s.allow_missing_robots, EXISTS (SELECT 1 FROM d WHERE d.brand = i0.brand AND d.domain = i0.domain) AS listed FROM i0 LEFT JOIN s ON i0.source_id = s.source_id AND s.enabled)
  {_rules('p', "'policy'", {'publication-enabled': 'publish_automatically', **{f'policy-bound:{c}': f'NOT {c} BETWEEN {a} AND {b}' for c, (a, b) in _POLICY_BOUNDS.items()}, 'request-budget-too-small': '(SELECT count(*) FROM q) * search_max_pages > request_budget'})}
  UNION ALL SELECT 'duplicate-query', category || ':' || brand FROM q GROUP BY category, brand HAVING count(*) > 1
  UNION ALL {_rules('q', "category || ':' || brand", {'invalid-query': f"NOT {_OK_CATEGORY} OR brand = ''"})}
  UNION ALL SELECT 'duplicate-index', index_id FROM i GROUP BY index_id HAVING count(*) > 1
  UNION ALL {_rules('i', 'index_id', {
      'index-source': f"type IS NULL OR type <> 'manufacturer-index' OR NOT {_UNDER('url', 'domain')}",
      'index-robots': 'robots_url IS NULL AND robots_checked_at IS NULL', 'index-robots-date': 'allow_missing_robots AND robots_checked_at IS NULL',
      'index-format': "format NOT IN ('html', 'sitemap')", 'index-target': f'NOT {_OK_CATEGORY}', 'index-domain': 'NOT listed'})}
  UNION ALL SELECT DISTINCT 'index-pattern', index_id FROM i WHERE pattern = '(['"""

_ONE_PROOF = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY official_url, verification, manufacturer, has_product) AS rn FROM ({plain_sql(PROOFS)})) WHERE rn = 1"
PRODUCTS_SQL = f"""WITH p AS ({plain_sql(PRODUCTS)}), m AS ({plain_sql(PROMOTED)}), v AS ({_ONE_PROOF}), j AS (SELECT m.*, verification, official_url FROM m LEFT JOIN v ON m.candidate_id = v.candidate_id)
  {_rules('p', 'product_id', {'invalid-category': f'NOT {_OK_CATEGORY}', 'documentary-price': 'new_price IS NOT NULL OR used_price IS NOT NULL'})}
  UNION ALL {_rules('j', 'product_id', {'invalid-promoted': f"NOT {_OK_CATEGORY} OR status <> 'Documentaire'", 'promoted-price': 'new_price IS NOT NULL', 'promoted-source': 'source IS NULL',
      'promoted-without-proof': "verification IS NULL OR verification <> 'verified'", 'promoted-source-mismatch': "verification = 'verified' AND (source IS NULL OR source <> official_url)"})}
  UNION ALL SELECT 'duplicate-product', product_id FROM (SELECT product_id FROM p UNION ALL SELECT product_id FROM m) GROUP BY product_id HAVING count(*) > 1"""

_CAND = f"c0 AS ({plain_sql(CANDIDATES)}), s AS ({plain_sql(SOURCES)}), d AS ({plain_sql(DOMAINS)}), c AS (SELECT c0.*, s.type, EXISTS (SELECT 1 FROM d WHERE d.brand = c0.brand AND {_UNDER('c0.url', 'd.domain')}) AS inside FROM c0 LEFT JOIN s ON c0.source_id = s.source_id AND s.enabled)"
_RETAIL = "(triage = 'retail-product' AND NOT duplicate)"
CANDIDATES_SQL = f"""WITH {_CAND} {_rules('c', 'candidate_id', {
    'candidate-category': f'NOT {_OK_CATEGORY}', 'candidate-source': 'type IS NULL', 'candidate-url': "url NOT LIKE 'https://%'",
    'local-path': "regexp_matches(concat_ws(chr(10), candidate_id, source_id, category, brand, url, description, status, triage, lane, triage_reason, blocker), '[A-Za-z]:\\\\|/Users/|/home/')",
    'auto-published': "status <> 'À vérifier'",
    'wrong-lane': "NOT ((lane = 'candidates' AND triage IN ('retail-product', 'product-family', 'component-model', 'needs-review')) OR (lane = 'identifiers' AND triage = 'hardware-identifier') OR (lane = 'rejected' AND triage = 'false-positive'))",
    'promotion-flag': f'promotable <> {_RETAIL}', 'triage-reason': "triage_reason = ''", 'promotion-blocker': f'NOT {_RETAIL} AND blocker IS NULL',
    'official-domain': "type = 'manufacturer-index' AND NOT inside", 'identifier-source': "lane = 'identifiers' AND source_id <> 'pci-ids'"})}"""
PROOFS_SQL = f"""WITH v0 AS ({plain_sql(PROOFS)}), d AS ({plain_sql(DOMAINS)}), c AS ({plain_sql(CANDIDATES)}),
  v AS (SELECT v0.*, c.brand, EXISTS (SELECT 1 FROM d WHERE d.brand = v0.manufacturer AND {_UNDER('v0.official_url', 'd.domain')}) AS inside FROM v0 LEFT JOIN c ON v0.candidate_id = c.candidate_id)
  SELECT 'duplicate-verification' AS rule, candidate_id AS subject FROM v GROUP BY candidate_id HAVING count(*) > 1
  UNION ALL {_rules('v', 'candidate_id', {'orphan-verification': 'brand IS NULL', 'manufacturer-mismatch': 'brand IS DISTINCT FROM manufacturer', 'verification-status': "verification = 'maybe'",
      'verification-url': 'NOT inside', 'verified-without-product': "verification = 'verified' AND NOT has_product", 'blocked-with-product': "verification <> 'verified' AND has_product"})}"""
EVIDENCE_SQL = f"""WITH {_CAND}, o AS (SELECT * FROM c WHERE lane = 'candidates' AND type = 'manufacturer-index'),
  e AS (SELECT page_id, CAST(page_id AS VARCHAR) AS id FROM pages WHERE CAST(page_id AS VARCHAR) IN (SELECT candidate_id FROM c)), j AS (SELECT e.*, o.url, o.inside FROM e JOIN o ON e.id = o.candidate_id)
  SELECT 'orphan-evidence' AS rule, id AS subject FROM e WHERE id NOT IN (SELECT candidate_id FROM o)
  UNION ALL {_rules('j', 'id', {'evidence-subject': 'page_id % 9 = 0', 'evidence-status': 'page_id % 7 = 0', 'evidence-review': 'page_id % 5 = 0', 'evidence-properties': 'page_id % 4 > 2',
      'evidence-match': 'page_id % 11 = 0', 'evidence-canonical': "url NOT LIKE 'https://%' OR NOT inside"})}
  UNION ALL SELECT 'policy-bound:evidence', '' FROM pages WHERE false"""

ORACLES = {
    "quality_registry": REGISTRY_SQL, "quality_products": PRODUCTS_SQL, "quality_candidates": CANDIDATES_SQL, "quality_verifications": PROOFS_SQL,
    "quality_evidence": EVIDENCE_SQL,
    "stream_counters": "SELECT event_type AS source_key, user_id % 7 AS category, count(*) AS read FROM events GROUP BY ALL",
    "next_collection": """WITH t AS (SELECT o_orderkey AS candidate_id, o_orderpriority AS source_id, CASE WHEN o_orderstatus = 'F' THEN o_custkey % 4 ELSE 0 END AS attempts FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')),
      r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY attempts, candidate_id) AS turn FROM t) SELECT * FROM r ORDER BY turn, source_id LIMIT 150""",
}
QUERIES = {name[2:]: query for name, query in list(globals().items()) if name.startswith("q_")}
