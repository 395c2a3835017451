"""Discovery: scoring, links, hardware ids, triage, lanes, coverage, promotion, evidence, outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearledger.catalogue_queries.shapes import CANDIDATES_SQL, candidates, fold_sql, pick, plain_sql, shape, table
from gearledger.functions.infer import SOCKET_MARKS
from gearledger.functions.specs import display, spec_map, text_spec
from gearledger.functions.urls import in_domains
from gearledger.model.dimensions import CATEGORY_TERMS, FALSE_POSITIVE_TERMS, FAMILY_TERMS, GENERIC_TOKENS, STRONG_FAMILY_PHRASES
from gearledger.operators.sets import flag_known
from gearledger.plans import discovery as jobs
from gearledger.plans import evidence as pages_jobs
from gearledger.plans import outline
from gearledger.functions.text import fold_text

QUERY_ROWS = f"""SELECT item_id AS query_id, {pick('item_id', 'cpu', 'gpu', 'motherboard', 'ram', 'psu', 'case', 'storage', 'cooling', 'expansion')} AS category,
  {pick('item_id', 'The', 'De', 'Of', 'Und')} AS brand, text AS query FROM {{benchmark}}"""
HITS = f"""SELECT doc_id % 40 AS query_id, CAST(doc_id AS STRING) AS external_id, source AS label,
  text || {pick('doc_id', ' graphics', ' Ryzen', ' motherboard rog', '', ' memory', ' supply', ' o11', ' nvme', ' cooler', ' ethernet', ' dark rock')} AS description FROM {{documents}}"""
SOURCE_ROWS = "SELECT 'src' || CAST(n_nationkey AS STRING) AS source_id, n_regionkey <> 2 AS enabled, CASE WHEN n_regionkey = 1 THEN 'manufacturer-index' ELSE 'open' END AS type FROM {nation}"
REGISTERED = "SELECT DISTINCT CASE n_regionkey WHEN 0 THEN 'cpu' WHEN 1 THEN 'gpu' WHEN 2 THEN 'ram' ELSE 'psu' END AS category, 'Maker ' || CAST(n_nationkey % 7 AS STRING) AS brand, n_name AS query FROM {nation}"


def _sources(spark, folder):
    return shape(spark, folder, SOURCE_ROWS)


def _known(spark, folder):
    """Identities: labels of the documents that were judged good."""
    good = shape(spark, folder, "SELECT CAST(doc_id AS STRING) AS candidate_id FROM {labels} WHERE quality = 1")
    named = candidates(spark, folder).join(good, "candidate_id", "left_semi")
    return named.select(fold_text(F.col("label")).alias("identity")).filter(F.col("identity") != "").distinct()


def _triaged(spark, folder):
    return jobs.triage(flag_known(candidates(spark, folder), _known(spark, folder)))


def q_score_hits(spark, folder):
    return jobs.score_hits(shape(spark, folder, HITS), shape(spark, folder, QUERY_ROWS)).select("candidate_id", "external_id", "brand", "category", "confidence", "score")


def q_triage(spark, folder):
    return _triaged(spark, folder).select("candidate_id", "triage", "duplicate", "promotable", "blocker", "lane")


def q_triage_counts(spark, folder):
    return jobs.triage_counts(_triaged(spark, folder))


def _run(spark, folder):
    rows = candidates(spark, folder)
    stored = rows.join(shape(spark, folder, "SELECT CAST(doc_id AS STRING) AS candidate_id FROM {labels}"), "candidate_id", "left_semi")
    previous = stored.withColumns({"duplicate": F.lit(False), "status": F.lit("À vérifier"), "first_seen": F.lit("2023-01-01")})
    english, other = rows.filter(F.col("brand") == "Maker en"), rows.filter(F.col("brand") != "Maker en")
    promoted = shape(spark, folder, "SELECT CAST(c_custkey AS STRING) AS candidate_id FROM {customer} WHERE c_acctbal > 8000")
    return jobs.discovery_run(previous, [english, other], _known(spark, folder), _sources(spark, folder), promoted, "2024-05-01", 1_000_000)


def q_discovery_run(spark, folder):
    return _run(spark, folder).select("candidate_id", "category", "brand", "triage", "promotable", "lane", "duplicate", "first_seen")


def q_candidate_queue(spark, folder):
    """The first rows of the review queue in its order."""
    return jobs.candidate_queue(flag_known(candidates(spark, folder), _known(spark, folder)), 300).select("candidate_id", "duplicate", "category")


def q_coverage_report(spark, folder):
    report = jobs.coverage_report(_triaged(spark, folder), shape(spark, folder, REGISTERED), _sources(spark, folder))
    return report.withColumns({c: F.array_join(c, "|") for c in ("registered_brands", "observed_brands")})


def q_coverage_totals(spark, folder):
    return jobs.coverage_totals(_triaged(spark, folder), shape(spark, folder, REGISTERED), _sources(spark, folder))


def q_collection_status(spark, folder):
    return jobs.collection_status(shape(spark, folder, """SELECT o_custkey AS run_id, 1 AS requested, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS succeeded,
      CASE WHEN o_orderstatus = 'F' OR o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS errors FROM {orders}"""))


INDEXES = """SELECT 'index ' || r_name AS index_id, 'official' AS source_id, CASE r_regionkey WHEN 0 THEN 'The' ELSE 'Maker' END AS brand, 'gpu' AS category,
  CASE r_regionkey WHEN 0 THEN 'example.com' WHEN 1 THEN 'example.net' ELSE 'example.org' END AS domain,
  CASE r_regionkey WHEN 0 THEN '^/[t-z]' WHEN 1 THEN '^/(a|e|o)' ELSE '^/' END AS product_pattern, r_regionkey * 40 + 30 AS max_candidates FROM {region}"""
PAGE_INDEX = "CASE WHEN url LIKE '%example.com%' THEN 'index AFRICA' WHEN url LIKE '%example.net%' THEN 'index AMERICA' ELSE 'index ASIA' END"


def _index_links(spark, folder, limit=None):
    indexes = shape(spark, folder, INDEXES).select(
        "index_id", "source_id", "brand", "category", F.array("domain").alias("domains"), F.array("product_pattern").alias("product_patterns"),
        F.array().cast("array<string>").alias("label_patterns"), "max_candidates", F.lit(-1).alias("label_segment"))
    stored = shape(spark, folder, f"SELECT {PAGE_INDEX} AS index_id, page_id AS page_no, url, html FROM {{pages}}")
    return jobs.discover_links(stored, indexes, limit).select("candidate_id", "external_id", "label", "brand", "query")


def q_discover_links(spark, folder):
    return _index_links(spark, folder)


def q_discover_quota(spark, folder):
    """The same under an overall quota of 50, filled index by index."""
    return _index_links(spark, folder, 50)


def q_sitemap_links(spark, folder):
    return jobs.sitemap_links(table(spark, folder, "pages").select("url", "page_id", F.lit(-1).alias("label_segment"))).select("page_id", "url", "label")


def q_trusted_domains(spark, folder):
    trusted = F.array(F.lit("example.com"), F.lit("M.therou.example.net"))
    return table(spark, folder, "pages").filter(in_domains(F.col("url"), trusted)).select("page_id", "url")


LINES = """SELECT 'ids' AS path, s_suppkey * 1000000000 AS line_no, printf('%04x', s_suppkey + 4096) || '  ' || s_name AS line FROM {supplier}
  UNION ALL SELECT DISTINCT 'ids', l_suppkey * 1000000000 + l_orderkey * 100 + l_linenumber, chr(9) || printf('%04x', l_partkey) || '  ' ||
    CASE l_linenumber WHEN 1 THEN 'Radeon ' WHEN 2 THEN 'NVMe storage controller ' WHEN 3 THEN 'Ethernet adapter ' WHEN 4 THEN 'SATA bridge ' ELSE 'Host bridge ' END || CAST(l_partkey AS STRING) FROM {lineitem}
  UNION ALL SELECT 'ids', o_orderkey * 60000000 + 7, '# comment ' || o_orderpriority FROM {orders}"""
VENDORS = "SELECT printf('%04x', s_suppkey + 4096) AS vendor_id, 'Brand ' || CAST(s_nationkey AS STRING) AS brand FROM {supplier} WHERE s_acctbal > 3000"


def q_hardware_candidates(spark, folder):
    found = jobs.hardware_candidates(shape(spark, folder, LINES), shape(spark, folder, VENDORS), 25, 300_000_000)
    return found.select("candidate_id", "external_id", "label", "brand", "category")


def q_promote(spark, folder):
    """Every labelled document is requested; one product or one refusal each."""
    promoted, refused = _promotion(spark, folder)
    return promoted.select("candidate_id", F.lit(0).alias("refusal"), "product_id").unionByName(
        refused.select("candidate_id", "refusal", F.lit(None).cast("string").alias("product_id")))


def _promotion(spark, folder):
    requested = shape(spark, folder, "SELECT CAST(doc_id + 5 AS STRING) AS candidate_id FROM {labels}")
    rows = candidates(spark, folder).withColumns({
        "duplicate": F.lit(False), "promotable": F.length("label") % 3 != 0, "blocker": F.lit("family"), "label": F.lower("label")})
    proofs = shape(spark, folder, "SELECT CAST(doc_id + 1 AS STRING) AS candidate_id, CASE WHEN quality = 1 THEN 'verified' ELSE 'rejected' END AS verification, 'https://m.example/p' AS official_url FROM {labels}")
    product = F.struct(
        F.lit("ref").alias("reference"), F.lit("serie").alias("series"), F.lit(2024).alias("year"), spec_map({"Socket": text_spec(F.lit("AM5"))}).alias("specs"),
        F.lit("").alias("notes"), F.lit("").alias("usage"))
    return jobs.promote(requested, rows, proofs.withColumn("product", product))


def q_promoted_catalogue(spark, folder):
    promoted, _refused = _promotion(spark, folder)
    stored = promoted.filter(F.col("category") == "cpu").withColumn("year", F.lit(2000))
    return jobs.promote_into(stored, promoted.filter(F.col("brand") == "Maker en")).select("candidate_id", "category", "year")


def _review(spark, folder):
    rows = candidates(spark, folder).select("candidate_id", "category")
    proofs = shape(spark, folder, "SELECT CAST(doc_id AS STRING) AS candidate_id, CASE WHEN quality = 1 THEN 'verified' ELSE 'rejected' END AS verification FROM {labels}")
    evidence = shape(spark, folder, "SELECT CAST(page_id * 2 AS STRING) AS candidate_id, 'page-metadata' AS status, 0.5 AS score FROM {pages}")
    specs = shape(spark, folder, "SELECT CAST(conv_id AS STRING) AS candidate_id, role AS field FROM {conversations}")
    return rows, proofs, evidence, specs


def q_review_queue(spark, folder):
    return jobs.review_queue(*_review(spark, folder)).withColumn("match_score", F.col("match_score").cast("double"))


def q_review_kpis(spark, folder):
    rows, proofs, _evidence, _specs = _review(spark, folder)
    return jobs.review_kpis(rows, proofs, shape(spark, folder, "SELECT CAST(c_custkey AS STRING) AS candidate_id FROM {customer} WHERE c_acctbal > 5000"))


PAGE_CANDIDATES = """SELECT CAST(p.page_id AS STRING) AS candidate_id, 'official' AS source_id, 'gpu' AS category, 'Maker ' || d.lang AS brand, d.text AS label, p.url
  FROM {pages} p JOIN {documents} d ON p.page_id = d.doc_id"""


def _page_evidence(spark, folder):
    domains = spark.range(1).select(F.explode(F.array(*[F.lit(f"Maker {c}") for c in ("en", "fr", "de", "es")])).alias("brand"), F.lit("example.com").alias("domain"))
    stored = table(spark, folder, "pages").groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    return pages_jobs.page_evidence(stored, shape(spark, folder, PAGE_CANDIDATES), domains, "2024-01-01")


def q_page_evidence(spark, folder):
    return _page_evidence(spark, folder).select(
        "candidate_id", "status", "page_title", "canonical_url", "score", F.array_join("signals", ",").alias("signals"), F.size("properties").cast("bigint").alias("n_properties"))


def q_evidence_summary(spark, folder):
    found = _page_evidence(spark, folder)
    return pages_jobs.evidence_summary(candidates(spark, folder).select("candidate_id"), found, table(spark, folder, "labels"))


SECTION_LINES = f"""SELECT 'doc ' || CAST(p_partkey % 2 AS STRING) AS doc, p_partkey * 10 AS line_no, 'paragraph' AS kind,
    CASE WHEN p_size % 9 = 0 THEN '11. Fin' WHEN p_size % 5 = 0 THEN 'Socket AM' || CAST(p_size AS STRING) || ' — notes' ELSE
      {pick('p_size', '2. Processeurs', '3. Cartes graphiques', '4. Cartes', '5. Mémoire', '6. Stockage', '7. Alimentations', '10. Extensions')} END AS text, '' AS a, '' AS b, '' AS c
    FROM {{part}} WHERE p_size < 20
  UNION ALL SELECT 'doc ' || CAST(p_partkey % 2 AS STRING), p_partkey * 10 + 5, 'row', '', CASE WHEN p_size % 17 = 0 THEN 'Type' WHEN p_size % 19 = 0 THEN 'ab' ELSE {pick('p_partkey', 'Ryzen ', 'Radeon ', 'Intel UHD ', 'Core ', 'Kit ')} || p_name || CASE WHEN p_size % 7 = 0 THEN ' / ' || p_type ELSE '' END END,
    CASE WHEN p_size % 4 = 0 THEN '' ELSE 'Sortie 20' || CAST(p_size % 30 + 10 AS STRING) || ' ' || p_brand END, p_type FROM {{part}}"""


def q_outline_sections(spark, folder):
    lines = shape(spark, folder, SECTION_LINES).withColumn("cells", F.array("a", "b", "c"))
    return outline.import_sections(lines, 500).select("doc", "line_no", "category", "brand", "name", "reference", "series", "year", "confidence")


def q_outline_deduplicated(spark, folder):
    lines = shape(spark, folder, SECTION_LINES).withColumn("cells", F.array("a", "b", "c"))
    return outline.deduplicate(outline.import_sections(lines, 500)).select("category", "doc", "line_no")


# Board lists: a brand heading, a context line, an entry whose models run over two lines.
BOARD_LINES = f"""SELECT 'boards' AS doc, p_partkey * 10 AS line_no, {pick('p_size', 'ASUS', 'MSI (cartes)', 'OEM propriétaires', 'Dell OptiPlex 7000', 'ASRock')} AS text FROM {{part}} WHERE p_size % 6 = 0
  UNION ALL SELECT 'boards', p_partkey * 10 + 1, {pick('p_size', 'AMD AM4 / DDR4', 'Intel LGA 1700 DDR5', 'Legacy Intel')} FROM {{part}} WHERE p_size % 4 = 0
  UNION ALL SELECT 'boards', p_partkey * 10 + 2, {pick('p_size', 'B550', 'Z790', 'X99', 'H510')} || ' (série) : ' || p_name || ' Pro, ' || p_type || ' MATX (a, b), Intel' FROM {{part}}
  UNION ALL SELECT 'boards', p_partkey * 10 + 3, 'ITX' || CAST(p_size AS STRING) || ', suite ' || p_type FROM {{part}} WHERE p_size % 3 = 0"""


def q_outline_boards(spark, folder):
    found = outline.import_boards(shape(spark, folder, BOARD_LINES), 700)
    shown = {k: display(F.col("specs")[k]) for k in ("Socket", "Format", "RAM")}
    return found.select("line_no", "item_no", "brand", "name", "reference", "series", *[v.alias(k.lower()) for k, v in shown.items()])


CS = CANDIDATES_SQL
_LABEL, _TEXT = fold_sql("label"), fold_sql("description")
_fold = jobs._fold  # the words are folded before they are written into the SQL


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{_fold(w)}')" for w in words) + ")"


_RETAIL = """(category = 'cpu' AND regexp_matches(l, '\\bryzen\\s+[3579]\\s+\\d{4}[a-z]{0,3}\\b|\\bthreadripper\\s+\\d{4}[a-z]{0,3}\\b|\\bcore\\s+i[3579][ -]?\\d{4,5}[a-z]{0,3}\\b'))
  OR (category = 'gpu' AND regexp_matches(l, '\\b(?:geforce\\s+)?rtx\\s+\\d{4}(?:\\s+super|\\s+ti)?\\b|\\b(?:radeon\\s+)?rx\\s+\\d{4}(?:\\s+xt|\\s+xtx)?\\b|\\barc\\s+[ab]\\d{3}\\b|\\bgtx\\s+\\d{3,4}(?:\\s+ti)?\\b'))
  OR (category = 'case' AND regexp_matches(l, '\\bo11\\s+dynamic\\b|\\bmasterbox\\b|\\bnzxt\\s+h\\d{3}\\b'))
  OR (category = 'storage' AND regexp_matches(l, '\\b\\d{3,4}\\s*(?:pro|evo)\\b|\\bfirecuda\\s+\\d+\\b'))"""
_TRIAGE = f"""known AS (SELECT DISTINCT {_LABEL} AS i FROM ({CS}) WHERE candidate_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1) AND {_LABEL} <> ''),
  f AS (SELECT *, {_LABEL} AS l, {_TEXT} AS d FROM ({CS})),
  k AS (SELECT *, l IN (SELECT i FROM known) AS duplicate, CASE WHEN source_id = 'pci-ids' OR kind = 'hardware-identifier' THEN 'hardware-identifier'
    WHEN {_any("l || ' ' || d", FALSE_POSITIVE_TERMS)} THEN 'false-positive' WHEN contains(l || ' ' || d, 'integrated') OR contains(l || ' ' || d, 'integre') THEN 'component-model'
    WHEN {_any('l', FAMILY_TERMS)} OR {_any('d', STRONG_FAMILY_PHRASES)} THEN 'product-family' WHEN {_RETAIL} THEN 'retail-product'
    WHEN {_any('d', FAMILY_TERMS)} THEN 'product-family' ELSE 'needs-review' END AS triage FROM f),
  t AS (SELECT *, triage = 'retail-product' AND NOT duplicate AS promotable, CASE WHEN duplicate THEN 'duplicate-identity' WHEN triage <> 'retail-product' THEN triage END AS blocker,
    CASE triage WHEN 'hardware-identifier' THEN 'identifiers' WHEN 'false-positive' THEN 'rejected' ELSE 'candidates' END AS lane FROM k)"""

_TERMS = "CASE category " + " ".join(f"WHEN '{c}' THEN [{', '.join(repr(w) for w in words)}]" for c, words in CATEGORY_TERMS.items()) + " END"
_WORDS = lambda c: f"list_distinct(string_split({fold_sql(c)}, ' '))"
HITS_SQL = f"""WITH q AS (SELECT *, {_WORDS('query')} AS qw, {_WORDS('brand')} AS bw, {_TERMS} AS cw FROM ({plain_sql(QUERY_ROWS)})),
  h AS (SELECT *, {_WORDS("label || ' ' || description")} AS w FROM ({plain_sql(HITS)})),
  j AS (SELECT h.external_id, q.*, CAST(len(list_intersect(qw, w)) AS DOUBLE) / len(qw) AS o, len(list_intersect(bw, w)) > 0 AS b, len(list_intersect(cw, w)) > 0 AS c FROM h JOIN q ON h.query_id = q.query_id),
  s AS (SELECT *, CASE WHEN b THEN 42e-2 ELSE 0e0 END + least(33e-2, o * 4e-1) + CASE WHEN c THEN 25e-2 ELSE 0e0 END AS score FROM j)
  SELECT 'candidate-' || substr(sha1('wikidata:' || external_id || ':' || category), 1, 16) AS candidate_id, external_id, brand, category,
    CASE WHEN score >= 72e-2 THEN 'Moyenne' ELSE 'Faible' END AS confidence, CAST(round(CAST(CAST(score AS VARCHAR) AS DECIMAL(30, 20)), 2) AS DOUBLE) AS score FROM s WHERE score >= 42e-2 AND (c OR o >= 65e-2)"""

RUN_SQL = f"""WITH {_TRIAGE}, src AS ({plain_sql(SOURCE_ROWS)}), lab AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM labels)
  SELECT candidate_id, category, brand, triage, promotable, lane, duplicate,
    CASE WHEN candidate_id IN (SELECT id FROM lab) AND source_id IN (SELECT source_id FROM src WHERE enabled) THEN '2023-01-01' ELSE '2024-05-01' END AS first_seen
  FROM t WHERE lane <> 'candidates' OR candidate_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 8000)"""

_OFFICIAL = f"source_id IN (SELECT source_id FROM ({plain_sql(SOURCE_ROWS)}) WHERE enabled AND type = 'manufacturer-index')"
COVERAGE_SQL = f"""WITH {_TRIAGE}, c AS (SELECT unnest(['cpu', 'gpu', 'motherboard', 'ram', 'psu', 'case', 'storage', 'cooling', 'expansion']) AS category),
  n AS (SELECT category, string_agg(DISTINCT brand, '|' ORDER BY brand) AS observed_brands, count(*) FILTER (lane = 'candidates') AS candidates, count(*) FILTER (lane = 'candidates' AND {_OFFICIAL}) AS official,
    count(*) FILTER (lane = 'candidates' AND promotable) AS promotable, count(*) FILTER (lane = 'identifiers') AS identifiers, count(*) FILTER (lane = 'rejected') AS rejected FROM t GROUP BY category),
  r AS (SELECT category, string_agg(DISTINCT brand, '|' ORDER BY brand) AS registered_brands FROM ({plain_sql(REGISTERED)}) GROUP BY category)
  SELECT c.category, coalesce(registered_brands, '') AS registered_brands, coalesce(observed_brands, '') AS observed_brands, coalesce(candidates, 0) AS candidates, coalesce(official, 0) AS official,
    coalesce(promotable, 0) AS promotable, coalesce(identifiers, 0) AS identifiers, coalesce(rejected, 0) AS rejected FROM c LEFT JOIN n USING (category) LEFT JOIN r USING (category)"""
TOTALS_SQL = f"""WITH {_TRIAGE}, r AS ({plain_sql(REGISTERED)}) SELECT count(*) FILTER (lane = 'candidates') AS candidates, count(*) FILTER (lane = 'candidates' AND {_OFFICIAL}) AS official,
  count(*) FILTER (lane = 'identifiers') AS identifiers, count(*) FILTER (lane = 'rejected') AS rejected, count(DISTINCT category) AS categories_with_candidates,
  (SELECT count(*) FROM r) AS registered_queries, (SELECT count(DISTINCT brand) FROM r) AS registered_brands, (SELECT count(DISTINCT category) FROM r) AS registered_categories FROM t"""

_TAIL = lambda u: f"regexp_extract({u}, '^https://[^/?#]*([^?#]*)', 1)"
_UNESCAPE = lambda c: f"replace(replace(replace(replace(replace({c}, '&quot;', chr(34)), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_SLUGGED = "trim(regexp_replace(list_filter(string_split(path, '/'), lambda x: x <> '')[-1], '[_-]', ' ', 'g'))"
LINKS_SQL = f"""WITH i AS ({plain_sql(INDEXES)}), v AS (SELECT {PAGE_INDEX} AS index_id, page_id, url, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', '', 'g') AS html FROM pages),
  a AS (SELECT index_id, page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a\\s*>')) AS anchor, generate_subscripts(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a\\s*>'), 1) - 1 AS pos FROM v),
  b AS (SELECT *, {_UNESCAPE("regexp_extract(anchor, 'href=\"([^\"]*)\"', 1)")} AS href, trim(regexp_replace({_UNESCAPE("regexp_replace(anchor, '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g'), ' -|·') AS caption,
    'https://' || lower(regexp_extract(url, '^https://([^/?#]*)', 1)) AS origin FROM a WHERE url LIKE 'https://%'),
  c AS (SELECT *, origin || {_TAIL("origin || href")} AS link, {_TAIL("origin || href")} AS path FROM b WHERE href <> ''),
  d AS (SELECT c.*, i.brand, i.max_candidates, CASE WHEN length(caption) >= 3 AND lower(caption) NOT IN ('product', 'products', 'image', 'all') THEN caption ELSE coalesce({_SLUGGED}, '') END AS label
    FROM c JOIN i ON c.index_id = i.index_id AND (regexp_extract(origin, '//(.*)', 1) = i.domain OR ends_with(origin, '.' || i.domain)) AND regexp_matches(path, '(?i)' || i.product_pattern)),
  e AS (SELECT index_id, page_id, link, brand, max_candidates, arg_max(label, [length(label), -pos]) AS label, min(pos) AS pos FROM d WHERE label <> '' GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, pos, index_id) AS once FROM e),
  r AS (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY page_id, pos) AS place FROM o WHERE once = 1)
  SELECT 'candidate-' || substr(sha1('official:' || link || ':gpu'), 1, 16) AS candidate_id, link AS external_id, CASE WHEN starts_with({fold_sql('label')}, {fold_sql('brand')}) THEN label ELSE brand || ' ' || label END AS label, brand, index_id AS query
  FROM r WHERE place <= max_candidates"""

SITEMAP_SQL = f"""WITH u AS (SELECT page_id, 'https://' || lower(regexp_extract(url, '^https://([^/?#]*)', 1)) || {_TAIL('url')} AS url, {_TAIL('url')} AS path FROM pages WHERE url LIKE 'https://%')
  SELECT page_id, url, trim(regexp_replace(regexp_replace(list_filter(string_split(path, '/'), lambda x: x <> '')[-1], '(?i)\\.(?:s?html?|php)$', ''), '[_-]', ' ', 'g')) AS label FROM u WHERE len(list_filter(string_split(path, '/'), lambda x: x <> '')) > 0"""
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1))"

HARDWARE_SQL = f"""WITH l AS (SELECT *, nullif(regexp_extract(line, '^([0-9a-f]{{4}})\\s', 1), '') AS v FROM ({plain_sql(LINES)}) WHERE line NOT LIKE '#%'),
  c AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS vendor_id FROM l),
  d AS (SELECT line_no, vendor_id, regexp_extract(line, '^\\t([0-9a-f]{{4}})', 1) AS device_id, trim(regexp_extract(line, '^\\t[0-9a-f]{{4}}\\s+(.+)$', 1)) AS device FROM c WHERE line LIKE chr(9) || '%'),
  k AS (SELECT d.*, brand, CASE WHEN lower(device) LIKE '%radeon%' THEN 'gpu' WHEN lower(device) LIKE '%nvme%' OR lower(device) LIKE '%sata%' THEN 'storage' WHEN lower(device) LIKE '%ethernet%' THEN 'expansion' END AS category
    FROM d JOIN ({plain_sql(VENDORS)}) n ON d.vendor_id = n.vendor_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY brand, category ORDER BY line_no) AS place FROM k WHERE category IS NOT NULL)
  SELECT 'candidate-' || substr(sha1('pci-ids:' || vendor_id || ':' || device_id || ':' || category), 1, 16) AS candidate_id, vendor_id || ':' || device_id AS external_id, brand || ' ' || device AS label, brand, category FROM r WHERE place <= 25"""

_PROMO = f"""c AS (SELECT *, lower(label) AS low, length(label) % 3 <> 0 AS promotable FROM ({CS})), q AS (SELECT DISTINCT CAST(doc_id + 5 AS VARCHAR) AS candidate_id FROM labels),
  v AS (SELECT CAST(doc_id + 1 AS VARCHAR) AS candidate_id, quality = 1 AS verified FROM labels),
  j AS (SELECT q.candidate_id, c.category, c.brand, CASE WHEN c.candidate_id IS NULL THEN 1 WHEN NOT promotable THEN 2 WHEN NOT coalesce(verified, false) THEN 3 ELSE 0 END AS refusal,
    'open-' || substr(trim(regexp_replace(lower(strip_accents(low)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 55) || '-' || substr(sha1(source_id || ':' || external_id), 1, 8) AS product_id
    FROM q LEFT JOIN c ON q.candidate_id = c.candidate_id LEFT JOIN v ON q.candidate_id = v.candidate_id)"""

_IGNORED = "[" + ", ".join(f"'{t}'" for t in GENERIC_TOKENS) + ", 'maker', lang]"
_CLEAN = lambda c: f"trim(regexp_replace({_UNESCAPE(c)}, '\\s+', ' ', 'g'))"
EVIDENCE_BODY = f"""h AS (SELECT url, arg_min(html, page_id) AS html FROM pages GROUP BY url),
  p AS (SELECT url, substr(coalesce(nullif({_CLEAN("regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), '<[^>]+>', ' ', 'g')")}, ''),
    {_CLEAN("regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '<[^>]+>', ' ', 'g')")}), 1, 240) AS title FROM h),
  w AS (SELECT CAST(g.page_id AS VARCHAR) AS candidate_id, g.url, title,
      list_filter({_WORDS('d.text')}, lambda x: x <> '' AND NOT list_contains({_IGNORED}, x)) AS a, list_filter({_WORDS('title')}, lambda x: x <> '' AND NOT list_contains({_IGNORED}, x)) AS b
    FROM pages g JOIN documents d ON g.page_id = d.doc_id JOIN p ON p.url = g.url),
  s AS (SELECT *, list_intersect(a, b) AS shared FROM w),
  e AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(greatest(2e0 * len(shared) / (len(a) + len(b)), 1e0 * len(shared) / least(len(a), len(b))), 2) END AS score FROM s),
  r AS (SELECT candidate_id, CASE WHEN title <> '' AND score >= 0.35 THEN 'page-metadata' ELSE 'insufficient-metadata' END AS status, title AS page_title, url AS canonical_url, score,
    coalesce(array_to_string(list_transform(list_sort(list_transform(shared, lambda x: lpad(CAST(1000000 - length(x) AS VARCHAR), 7, '0') || x))[1:12], lambda x: substr(x, 8)), ','), '') AS signals, 0 AS n_properties FROM e)"""

_SEC_CATEGORY = "CASE WHEN text LIKE '2. %' THEN 'cpu' WHEN text LIKE '3. %' THEN 'gpu' WHEN text LIKE '4. %' THEN 'motherboard' WHEN text LIKE '5. %' THEN 'ram' WHEN text LIKE '6. %' THEN 'storage' WHEN text LIKE '7. %' THEN 'psu' WHEN text LIKE '10. %' THEN 'expansion' WHEN text LIKE '11.%' THEN '' END"
_AMD = "regexp_matches(lower(a || ' ' || ctx), 'ryzen|athlon|phenom|threadripper|epyc|fx-|apu')"
_CLEAN_P = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'), ' ,.;')"
_FIRST = lambda c: f"regexp_split_to_array({c}, '\\s[/,]\\s|\\s→\\s')[1]"
_COMPACT = lambda brand, c: _CLEAN_P(f"CASE WHEN NOT contains(lower({_FIRST(c)}), lower({brand})) AND {brand} <> 'À vérifier' THEN {brand} || ' ' ELSE '' END || {_FIRST(c)} || CASE WHEN {_FIRST(c)} <> {c} THEN ' et variantes' ELSE '' END")
SECTIONS_SQL = f"""WITH l AS (SELECT *, CASE WHEN kind = 'paragraph' THEN {_SEC_CATEGORY} END AS cat0, CASE WHEN kind = 'paragraph' THEN text END AS ctx0 FROM ({plain_sql(SECTION_LINES)})),
  k AS (SELECT *, last_value(cat0 IGNORE NULLS) OVER w AS category, coalesce(last_value(ctx0 IGNORE NULLS) OVER w, '') AS ctx FROM l WINDOW w AS (PARTITION BY doc ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
  r AS (SELECT doc, line_no, category, ctx, a, concat_ws(' · ', nullif(b, ''), nullif(c, '')) AS detail FROM k WHERE kind = 'row' AND category <> '' AND lower(a) <> 'type' AND length(a) >= 3),
  x AS (SELECT *, CASE WHEN category = 'cpu' THEN CASE WHEN {_AMD} THEN 'AMD' ELSE 'Intel' END WHEN category = 'gpu' THEN CASE WHEN regexp_matches(lower(a || ' ' || ctx), 'radeon|firepro|instinct') THEN 'AMD' WHEN regexp_matches(lower(a || ' ' || ctx), 'arc |intel hd|intel uhd|iris') THEN 'Intel' ELSE 'NVIDIA' END
      WHEN category IN ('ram', 'storage') AND len(string_split(a, ' ')) <= 4 THEN a ELSE 'À vérifier' END AS brand FROM r WHERE category <> 'motherboard')
  SELECT doc, line_no, category, brand, CASE WHEN category IN ('cpu', 'gpu') THEN {_COMPACT('brand', 'a')} ELSE {_COMPACT('brand', 'detail')} END AS name, CASE WHEN category IN ('cpu', 'gpu') THEN a ELSE detail END AS reference,
    CASE WHEN category IN ('cpu', 'gpu') THEN coalesce(nullif({_CLEAN_P("string_split(ctx, '—')[1]")}, ''), 'À vérifier') ELSE a END AS series,
    CAST(nullif(regexp_extract(CASE WHEN category IN ('cpu', 'gpu') THEN detail || ' ' || ctx ELSE detail END, '(?:19|20)\\d{{2}}'), '') AS INT) AS year, CASE WHEN category IN ('cpu', 'gpu') THEN 'Moyenne' ELSE 'Faible' END AS confidence FROM x"""

_MARKS = " ".join(
    "WHEN " + " OR ".join(f"contains(upper(key || ' ' || ctx), '{m}')" for m in marks) + f" THEN '{socket}'" for marks, socket in SOCKET_MARKS)
_STARTS = lambda words: "(" + " OR ".join(f"starts_with(text, '{w}')" for w in words) + ")"
_BRAND = "CASE " + " ".join(f"WHEN text = '{k}' OR starts_with(text, '{k} (') THEN '{v}'" for k, v in outline.BRAND_HEADINGS.items()) + " " + " ".join(
    f"WHEN starts_with(text, '{k}') THEN '{v}'" for k, v in outline.OEM_HEADINGS.items()) + f" WHEN starts_with(text, '{outline.OEM_RESET}') THEN 'À vérifier' END"
BOARDS_SQL = rf"""WITH t AS (SELECT doc, line_no, {_CLEAN_P('text')} AS text FROM ({plain_sql(BOARD_LINES)})),
  r AS (SELECT *, {_BRAND} AS brand0, regexp_extract(text, '^([^:]{{1,65}}?)\s*:\s*(.+)$', 1) AS key0 FROM t),
  m AS (SELECT *, CASE WHEN brand0 IS NOT NULL THEN 'brand' WHEN {_STARTS(outline.CONTEXT_STARTS)} THEN 'context' WHEN regexp_matches(key0, '[0-9]') THEN 'entry' ELSE 'more' END AS role FROM r),
  c AS (SELECT *, last_value(brand0 IGNORE NULLS) OVER w AS brand, coalesce(last_value(CASE WHEN role IN ('brand', 'context') THEN text END IGNORE NULLS) OVER w, '') AS ctx,
      last_value(CASE WHEN role <> 'more' THEN line_no END IGNORE NULLS) OVER w AS entry, last_value(CASE WHEN role <> 'more' THEN role END IGNORE NULLS) OVER w AS entry_role
    FROM m WINDOW w AS (PARTITION BY doc ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
  e AS (SELECT entry AS line_no, {_CLEAN_P('max(CASE WHEN role = ' + "'entry'" + ' THEN key0 END)')} AS key, arg_min(brand, line_no) AS brand, arg_min(ctx, line_no) AS ctx,
      {_CLEAN_P(r"string_agg(CASE WHEN role = 'entry' THEN regexp_extract(text, '^[^:]*:\s*(.*)$', 1) ELSE text END, ' ' ORDER BY line_no)")} AS value
    FROM c WHERE entry_role = 'entry' GROUP BY entry),
  k AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(value, '\(([^(),]*),([^(),]*)\)', '(\1§\2)', 'g'), ','), lambda x: trim(replace(x, '§', ','), ' ,.;')),
      lambda x: length(x) >= 3 AND lower(x) NOT IN ('intel', 'amd', 'legacy')) AS models FROM e WHERE brand IS NOT NULL AND brand <> 'À vérifier' AND key <> '' AND value <> ''),
  u AS (SELECT *, unnest(models) AS model0, generate_subscripts(models, 1) - 1 AS item_no FROM k),
  v AS (SELECT *, trim(regexp_replace(model0, '(?i)^(ASUS|BIOSTAR|NZXT)\s+', ''), ' ,.;') AS model, trim(regexp_extract(key, '^([^(]*)', 1), ' ,.;') AS series FROM u)
  SELECT line_no, item_no, brand, CASE WHEN contains(lower(model), lower(brand)) THEN model ELSE brand || ' ' || model END AS name, model AS reference, series,
    CASE {_MARKS} ELSE coalesce(nullif(regexp_extract(upper(key || ' ' || ctx), '(LGA\s*\d+(?:\s*V[12])?|AM[345]\+?|STRX4|STR5|TR4)', 1), ''), 'À vérifier') END AS socket,
    CASE WHEN contains(upper(model), 'ITX') THEN 'Mini-ITX' WHEN contains(upper(model), 'MATX') THEN 'Micro-ATX' ELSE 'À vérifier' END AS format,
    CASE WHEN contains(upper(ctx), 'DDR5') THEN 'DDR5' WHEN contains(upper(ctx), 'DDR4') THEN 'DDR4' ELSE 'À vérifier' END AS ram FROM v"""

ORACLES = {
    "outline_boards": BOARDS_SQL,
    "score_hits": HITS_SQL,
    "triage": f"WITH {_TRIAGE} SELECT candidate_id, triage, duplicate, promotable, blocker, lane FROM t",
    "triage_counts": f"WITH {_TRIAGE} SELECT triage, count(*) AS count FROM t GROUP BY triage",
    "discovery_run": RUN_SQL,
    "candidate_queue": f"WITH {_TRIAGE} SELECT candidate_id, duplicate, category FROM t ORDER BY duplicate, category, lower(brand), lower(label), candidate_id LIMIT 300",
    "coverage_report": COVERAGE_SQL,
    "coverage_totals": TOTALS_SQL,
    "collection_status": """WITH r AS (SELECT o_custkey AS run_id, count(*) AS requested, count(*) FILTER (o_orderstatus <> 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'F' OR o_orderpriority = '5-LOW') AS errors FROM orders GROUP BY o_custkey)
      SELECT *, CASE WHEN errors = 0 THEN 'success' WHEN succeeded > 0 THEN 'partial' ELSE 'failed' END AS status FROM r""",
    "discover_links": LINKS_SQL, "discover_quota": f"{LINKS_SQL} ORDER BY index_id, place LIMIT 50",
    "sitemap_links": SITEMAP_SQL,
    "trusted_domains": f"SELECT page_id, url FROM pages WHERE {_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com') OR {_HOST} = 'm.therou.example.net' OR ends_with({_HOST}, '.m.therou.example.net')",
    "hardware_candidates": HARDWARE_SQL,
    "promote": f"WITH {_PROMO} SELECT candidate_id, refusal, CASE WHEN refusal = 0 THEN product_id END AS product_id FROM j",
    "promoted_catalogue": f"WITH {_PROMO} SELECT candidate_id, category, CASE WHEN brand = 'Maker en' THEN 2024 ELSE 2000 END AS year FROM j WHERE refusal = 0 AND (category = 'cpu' OR brand = 'Maker en')",
    "review_queue": f"""WITH c AS (SELECT candidate_id, category FROM ({CS})) SELECT c.*, CASE WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'rejected' END AS verification,
      CASE WHEN page_id IS NOT NULL THEN 'page-metadata' END AS evidence, CASE WHEN page_id IS NOT NULL THEN 0.5e0 END AS match_score, coalesce(n, 0) AS n_specs
      FROM c LEFT JOIN labels ON c.candidate_id = CAST(labels.doc_id AS VARCHAR) LEFT JOIN pages ON c.candidate_id = CAST(page_id * 2 AS VARCHAR) LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) s ON c.candidate_id = CAST(conv_id AS VARCHAR)""",
    "review_kpis": f"""WITH c AS (SELECT candidate_id FROM ({CS})) SELECT count(*) FILTER (quality = 1) AS verified, count(*) FILTER (c_custkey IS NOT NULL) AS integrated, count(*) FILTER (quality IS NULL AND c_custkey IS NULL) AS pending
      FROM c LEFT JOIN labels ON c.candidate_id = CAST(labels.doc_id AS VARCHAR) LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) i ON c.candidate_id = CAST(c_custkey AS VARCHAR)""",
    "page_evidence": f"WITH {EVIDENCE_BODY} SELECT * FROM r",
    "evidence_summary": f"""WITH {EVIDENCE_BODY}, t AS (SELECT (SELECT count(*) FROM documents) AS official, (SELECT count(*) FROM r) AS collected, (SELECT count(*) FROM labels) AS failures)
      SELECT 'official' AS name, official AS value FROM t UNION ALL SELECT 'collected', collected FROM t UNION ALL SELECT 'remaining', official - collected FROM t UNION ALL SELECT 'failures', failures FROM t
      UNION ALL SELECT 'status:' || s, (SELECT count(*) FROM r WHERE status = s) FROM (SELECT unnest(['insufficient-metadata', 'page-metadata', 'structured-product']) AS s)""",
    "outline_sections": SECTIONS_SQL,
    "outline_deduplicated": f"""WITH s AS ({SECTIONS_SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY category, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') ORDER BY doc, line_no) AS rn FROM s) SELECT category, doc, line_no FROM o WHERE rn = 1""",
}
QUERIES = {name[2:]: query for name, query in list(globals().items()) if name.startswith("q_")}
