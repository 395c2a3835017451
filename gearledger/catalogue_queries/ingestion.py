"""Normalisation, entity resolution, survivorship, duplicates, whole ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearledger.catalogue_queries.shapes import COMPONENTS, PRODUCTS, SPEC_COLUMNS, dealt, fold_sql, plain_sql, products, round_sql, shape, spread
from gearledger.functions.identity import codes, identity_hash
from gearledger.functions.specs import SPEC, number_spec, spec_map, text_spec
from gearledger.functions.text import fold_text
from gearledger.operators import duplicates, resolution, survivorship
from gearledger.plans import ingest as ingestion
from gearledger.plans import normalize

# Records of two sources over the parts: the same part can come twice, with other spellings and codes.
RECORDS = f"""SELECT 'a' || component_id AS record_id, CAST(component_id AS BIGINT) AS arrival, 'open' AS source_key, component_id AS source_record_id,
    category, brand, name, mpn, ean_number, capacity, socket FROM ({COMPONENTS}) c
  UNION ALL SELECT 'b' || component_id, 1000000000 + CAST(component_id AS BIGINT), 'export', component_id, category, lower(brand), upper(name),
    CASE WHEN completeness % 2 = 0 THEN NULL ELSE mpn END, ean_number, CAST(capacity AS INT), socket FROM ({COMPONENTS}) d WHERE confidence > 60"""


def records(spark, folder):
    flat = shape(spark, folder, RECORDS)
    none = F.lit(None).cast("string")
    numbers = F.when(F.col("mpn").isNotNull(), F.array("mpn")).otherwise(F.array().cast("array<string>"))
    specs = spec_map({"capacity": number_spec(F.col("capacity")), "socket": text_spec(F.col("socket"))})
    return flat.select(
        "record_id", "arrival", "source_key", "source_record_id", "category", "brand", "name", numbers.alias("part_numbers"), specs.alias("specs"),
        F.col("capacity").cast("double").alias("capacity"), fold_text(F.col("brand")).alias("brand_folded"),
        identity_hash(F.col("brand"), F.col("name"), F.col("category"), specs).alias("identity_hash"),
        codes(numbers, F.col("brand"), none, F.col("ean_number").cast("string"), none).alias("codes"),
    )


def _stored(spark, folder):
    """Catalogue made of the first source: every record is a component."""
    base = records(spark, folder).filter(F.col("source_key") == "open")
    components = base.select(F.col("record_id").alias("component_id"), "category", "identity_hash")
    sources = base.select(F.col("record_id").alias("component_id"), "source_key", "source_record_id")
    identifiers = base.select(F.col("record_id").alias("component_id"), F.explode("codes").alias("c")).select("component_id", "c.type", "c.value", "c.scope").distinct()
    return components, sources, identifiers


def q_record_codes(spark, folder):
    rows = records(spark, folder).select("record_id", F.explode("codes").alias("c"))
    return rows.select("record_id", F.col("c.rank").cast("bigint").alias("rank"), "c.type", "c.value", "c.scope")


def q_identity_groups(spark, folder):
    """How many records share a strict identity."""
    return records(spark, folder).groupBy("identity_hash").agg(F.count("*").alias("records"), F.min("record_id").alias("first")).select("first", "records")


def q_match_codes(spark, folder):
    components, _sources, identifiers = _stored(spark, folder)
    return resolution.match_codes(records(spark, folder).filter(F.col("source_key") == "export"), identifiers)


def q_match_identity(spark, folder):
    components, _sources, _identifiers = _stored(spark, folder)
    return resolution.match_identity(records(spark, folder).filter(F.col("source_key") == "export"), components)


def q_match_source(spark, folder):
    _components, sources, _identifiers = _stored(spark, folder)
    return resolution.match_source(records(spark, folder).withColumn("source_key", F.lit("open")), sources)


def q_match_tiers(spark, folder):
    components, sources, identifiers = _stored(spark, folder)
    return resolution.match_tiers(records(spark, folder).filter(F.col("source_key") == "export"), sources, identifiers, components)


def q_resolve_entities(spark, folder):
    """The second source taken into a catalogue made of the first, each record seeing those before it."""
    components, sources, identifiers = _stored(spark, folder)
    return resolution.resolve_entities(records(spark, folder).filter(F.col("source_key") == "export"), sources, identifiers, components)


def q_cluster(spark, folder):
    return resolution.cluster(records(spark, folder))


PAIRS = "SELECT DISTINCT 'a' || CAST(l_partkey AS STRING) AS left_id, 'b' || CAST(l_suppkey * 20 + l_linenumber AS STRING) AS right_id FROM {lineitem}"
SAME_PAIRS = f"SELECT 'a' || component_id AS left_id, 'b' || component_id AS right_id FROM ({COMPONENTS}) c"


def q_match_reason(spark, folder):
    # Dealt as the join with the left records needs them: one shuffle for both.
    pairs = shape(spark, folder, PAIRS).unionByName(shape(spark, folder, SAME_PAIRS)).repartition("left_id").distinct()
    return resolution.match_reason(pairs, records(spark, folder))


FIELDS = """SELECT CAST(l_partkey AS STRING) AS component_id, 'field ' || CAST(l_linenumber AS STRING) AS key,
  CASE WHEN l_suppkey % 5 = 0 THEN '' WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'value ' || CAST(l_suppkey AS STRING) END AS text,
  CASE l_returnflag WHEN 'A' THEN 'curated' WHEN 'R' THEN 'open' ELSE 'export' END AS source,
  CASE l_returnflag WHEN 'A' THEN 90 WHEN 'R' THEN 70 ELSE 60 END AS priority, 80 AS confidence,
  l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS arrival FROM {lineitem}"""


def q_survive_fields(spark, folder):
    rows = shape(spark, folder, FIELDS)
    # A field without a value is JSON null; equal arrivals are told apart by the value itself.
    value = F.coalesce(text_spec(F.col("text")), F.struct(
        F.lit("null").alias("kind"), *[F.lit(None).cast(t).alias(n) for n, t in (("s", "string"), ("n", "double"), ("b", "boolean"), ("a", "array<string>"))]))
    fields = rows.groupBy("component_id", "key", "arrival").agg(
        F.max(F.struct("priority", F.coalesce("text", F.lit("")).alias("t"), "text", "source", "confidence")).alias("r")
    ).select("component_id", "key", "arrival", "r.text", "r.source", "r.priority", "r.confidence")
    won = survivorship.survive(fields.withColumn("value", value.cast(SPEC)).drop("text"))
    return won.select("component_id", "key", F.col("value.s").alias("value"), "source", "priority", "arrival")


def q_union_part_numbers(spark, folder):
    rows = shape(spark, folder, "SELECT CAST(l_suppkey AS STRING) AS component_id, l_orderkey AS arrival, 'N' || CAST(l_partkey % 40 AS STRING) AS a, 'M' || CAST(l_linenumber AS STRING) AS b FROM {lineitem}")
    found = survivorship.union_part_numbers(rows.select("component_id", "arrival", F.array("a", "b").alias("part_numbers")))
    return found.select("component_id", F.array_join(F.array_sort("part_numbers"), ",").alias("part_numbers"))


NAMED = f"SELECT CAST(component_id AS BIGINT) AS record_id, brand, name || ' ' || coalesce(socket, '') || ' ' || category AS name, mpn FROM ({COMPONENTS}) c"


def _named(spark, folder):
    rows = shape(spark, folder, NAMED)
    numbers = F.when(F.col("mpn").isNotNull(), F.array(F.concat(F.lit("PART"), F.col("mpn")))).otherwise(F.array().cast("array<string>"))
    return rows.select("record_id", "brand", "name", numbers.alias("part_numbers"))


def q_duplicate_pairs(spark, folder):
    found = duplicates.duplicate_pairs(_named(spark, folder), 0.6)
    return found.select("left_id", "right_id", "left_copies", "right_copies", F.round("jaccard", 6).alias("jaccard"), "linked", "score")


def q_duplicate_copies(spark, folder):
    return duplicates.copies(_named(spark, folder))


def q_prefix_numbers(spark, folder):
    """Part numbers of one brand that start another."""
    rows = shape(spark, folder, f"SELECT component_id AS record_id, brand, name, 'ABCD' || CAST(completeness AS STRING) || CASE WHEN confidence > 70 THEN 'X' ELSE '' END AS number FROM ({COMPONENTS}) c")
    members = duplicates.name_members(rows.select("record_id", "brand", "name", F.array("number").alias("part_numbers")))
    return duplicates.prefix_numbers(members).select("brand", "long", "short")


def curated(spark, folder):
    return products(spark, folder, part=dealt(spark, folder, "part", "p_partkey")).withColumns({
        "product_id": F.col("product_id").cast("string"), "confidence": F.when(F.col("year") > 2020, "Bonne").when(F.col("year") > 2014, "Moyenne").otherwise("Faible"),
        "notes": F.concat(F.lit("note "), "name"), "usage": F.lit(""), "source": F.lit("https://maker.example/p"),
    })


_CANON = ["source_record_id", "category", "subcategory", "model", "series", "slug", "mpn", "description", "short_description", "release_date",
          "completeness", "confidence", "missing_mpn", "missing_specs", "needs_review"]


def q_normalize_curated(spark, folder):
    return normalize.normalize_curated(curated(spark, folder)).select(*_CANON)


OPEN = f"""SELECT CASE p_partkey % 6 WHEN 0 THEN 'CPU' WHEN 1 THEN 'RAM' WHEN 2 THEN 'Storage' WHEN 3 THEN 'PSU' WHEN 4 THEN 'Monitor' ELSE 'Fridge' END AS folder,
  lpad(CAST(p_partkey AS STRING), 12, '0') AS digits, p_name, p_brand, p_size, p_partkey, p_type FROM {{part}}"""


def open_files(spark, folder):
    """Open database files written as JSON text from the parts, then parsed like files."""
    rows = spread(spark, folder, OPEN, "part", "digits")
    c = F.col
    text = F.to_json(F.struct(
        F.when(c("p_size") % 10 == 0, "not-a-uuid").otherwise(F.concat(F.lit("00000000-0000-4000-8000-"), "digits")).alias("opendb_id"),
        F.struct(
            F.when(c("p_size") % 13 == 0, "").otherwise(F.concat(F.lit(" "), "p_name")).alias("name"), c("p_brand").alias("manufacturer"),
            F.when(c("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("MP"), "p_partkey"), F.concat(F.lit(" MP"), "p_partkey"))).alias("part_numbers"),
            F.when(c("p_size") % 4 != 0, c("p_type")).alias("series"), F.lit(" ").alias("variant"), (c("p_size") + 1960).alias("releaseYear"),
        ).alias("metadata"),
        F.when(c("p_size") % 2 == 0, c("p_size")).alias("capacity"), F.lit("LGA 1151").alias("socket"), (c("p_size") * 10).alias("wattage"),
        F.array(F.lit("HDMI"), F.lit("DP")).alias("connectors"),
        F.struct(F.lit("https://maker.example/x").alias("manufacturer_url"), F.lit("DROP").alias("amazon_sku")).alias("general_product_information"),
    ))
    # Out of an array: a rule over the files is then not pushed in front of the dealing, and each text is made and parsed once, not once per use.
    return rows.select("folder", F.col("digits").alias("file_id"), F.explode(F.array(F.try_parse_json(text))).alias("data"))


def q_validate_open_db(spark, folder):
    _valid, refused = normalize.validate_open_db(open_files(spark, folder))
    return refused.select("file_id", F.array_join(F.array_sort("errors"), ",").alias("errors"))


def q_normalize_open_db(spark, folder):
    valid, _refused = normalize.validate_open_db(open_files(spark, folder))
    found = normalize.normalize_open_db(valid)
    return found.select(*_CANON, "name", F.array_join("part_numbers", ",").alias("part_numbers"), F.size("specs").cast("bigint").alias("n_specs"),
                        "source_url", F.contains("raw", F.lit("amazon_sku")).alias("leaks"))


EXPORT_ROWS = """SELECT CAST(s_suppkey AS STRING) AS icecat_id, CASE s_nationkey % 4 WHEN 0 THEN 'gpu' WHEN 1 THEN 'fan' WHEN 2 THEN 'fridge' ELSE 'ram' END AS category,
  'Brand ' || CAST(s_nationkey AS STRING) AS brand, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE 'E-' || CAST(s_suppkey AS STRING) END AS mpn, s_name AS name,
  CASE WHEN s_acctbal > 5000 THEN 'long text' END AS description, CASE WHEN s_acctbal < 3000 THEN 'https://img.example/a.png' END AS image, s_nationkey FROM {supplier}"""


def _export(spark, folder):
    rows = shape(spark, folder, EXPORT_ROWS)
    none = F.lit(None).cast("string")
    return rows.withColumns({
        "gtin": none, "ean": F.concat(F.lit("400"), "icecat_id"), "upc": none, "short_description": none, "source_url": none, "license": F.lit("open"), "raw": F.lit("{}"),
        "images": F.struct(F.col("image").alias("main"), F.array().cast("array<string>").alias("gallery")),
        "specs": spec_map({"memory": number_spec(F.col("s_nationkey")), "bus": text_spec(F.when(F.col("s_nationkey") > 9, "256 bit"))}),
    })


def q_normalize_export(spark, folder):
    valid, _refused = normalize.validate_export(_export(spark, folder))
    return normalize.normalize_export(valid).select(*_CANON, "missing_image", "search_document")


def q_validate_export(spark, folder):
    _valid, refused = normalize.validate_export(_export(spark, folder))
    return refused.select("icecat_id", F.array_join(F.array_sort("errors"), ",").alias("errors"))


def waves(spark, folder):
    valid, _refused = normalize.validate_open_db(open_files(spark, folder))
    exported, _refused = normalize.validate_export(_export(spark, folder))
    return [normalize.normalize_curated(curated(spark, folder)), normalize.normalize_open_db(valid), normalize.normalize_export(exported)]


def q_ingest(spark, folder):
    """Three waves of sources into an empty catalogue: outcomes per source and category."""
    _tables, outcomes = ingestion.sync(spark, waves(spark, folder), None, "2024-01-01")
    return outcomes.groupBy("source_key", "category", "outcome").agg(F.count("*").alias("records"))


def q_ingest_components(spark, folder):
    """The merged components of the same three waves."""
    tables, _outcomes = ingestion.sync(spark, waves(spark, folder), None, "2024-01-01")
    return tables.components.select("component_id", "category", "brand", "name", "mpn", "completeness", "confidence", "needs_review", F.size("specs").cast("bigint").alias("n_specs"))


R = plain_sql(RECORDS)
_IDENT = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"
_CODES = f"""codes AS (SELECT record_id, 'mpn' AS type, {_IDENT.format('mpn')} AS value, {fold_sql('brand')} AS scope, 0 AS ord FROM r WHERE mpn IS NOT NULL
    UNION ALL SELECT record_id, 'ean', CAST(ean_number AS VARCHAR), '', 1 FROM r WHERE ean_number IS NOT NULL),
  ranked AS (SELECT record_id, type, value, scope, row_number() OVER (PARTITION BY record_id ORDER BY ord) - 1 AS rank FROM codes WHERE length(value) >= 4)"""
_IDENTITY = f"{fold_sql('brand')} || '|' || {fold_sql('name')} || '|' || category || '|' || coalesce(CAST(capacity AS VARCHAR), '') || '|' || coalesce(socket, '')"
_BASE = f"r AS ({R}), {_CODES}, i AS (SELECT record_id, source_key, source_record_id, category, brand, capacity, {_IDENTITY} AS identity FROM r)"
_MATCH_CODES = """mc AS (SELECT k.record_id, arg_min(s.component_id, k.rank) AS component_id FROM ranked k JOIN
    (SELECT type, value, scope, min(record_id) AS component_id FROM ranked WHERE record_id LIKE 'a%' GROUP BY ALL HAVING count(DISTINCT record_id) = 1) s
    ON k.type = s.type AND k.value = s.value AND k.scope = s.scope WHERE k.record_id LIKE 'b%' GROUP BY k.record_id)"""
_MATCH_IDENTITY = """mi AS (SELECT i.record_id, s.component_id FROM i JOIN (SELECT identity, min(record_id) AS component_id FROM i WHERE record_id LIKE 'a%' GROUP BY identity HAVING count(*) = 1) s
    ON i.identity = s.identity WHERE i.record_id LIKE 'b%')"""

_WORDS = f"list_sort(list_distinct(string_split({fold_sql('name')}, ' ')))"
_GROUPS = f"""n AS (SELECT record_id, {fold_sql('brand')} AS brand, {_WORDS} AS words, 'PART' || {_IDENT.format("coalesce(mpn, '')")} AS num, mpn FROM ({plain_sql(NAMED)})),
  g AS (SELECT brand, words, min(record_id) AS id, count(*) AS copies, list_distinct(list(num) FILTER (mpn IS NOT NULL)) AS nums FROM n GROUP BY brand, words)"""

_CUR = plain_sql(PRODUCTS)
_SPEC_COUNT = " + ".join(
    "CAST((" + " OR ".join(f"{c} IS NOT NULL" for c, (f, _k, _s) in SPEC_COLUMNS.items() if f == field) + ") AS INT)"
    for field in dict.fromkeys(f for f, _k, _s in SPEC_COLUMNS.values()))
_SLUG = lambda n: f"CASE WHEN {fold_sql(n)} = '' THEN 'composant' ELSE substr(replace({fold_sql(n)}, ' ', '-'), 1, 160) END"
CURATED_SQL = f"""WITH p AS (SELECT *, {_SPEC_COUNT} AS n_specs, CASE WHEN year > 2020 THEN 92 WHEN year > 2014 THEN 72 ELSE 50 END AS trust FROM ({_CUR})),
  s AS (SELECT *, least(100, 35 + 25 + least(35, n_specs * 3)) AS completeness FROM p)
  SELECT CAST(product_id AS VARCHAR) AS source_record_id, CASE category WHEN 'expansion' THEN 'network' ELSE category END AS category, CASE WHEN category = 'expansion' THEN category END AS subcategory,
    name AS model, series, {_SLUG('name')} || '-' || substr(sha1(CAST(product_id AS VARCHAR)), 1, 8) AS slug, reference AS mpn, 'note ' || name AS description, NULL AS short_description,
    CASE WHEN year IS NOT NULL THEN make_date(year, 1, 1) END AS release_date, completeness, {round_sql('(trust * 3 + completeness) / 4e0')} AS confidence,
    false AS missing_mpn, n_specs = 0 AS missing_specs, n_specs < 2 AS needs_review FROM s"""

_OPEN_ERRORS = "concat_ws(',', CASE WHEN folder = 'Fridge' THEN 'category' END, CASE WHEN p_size % 13 = 0 THEN 'name' END, CASE WHEN p_size % 10 = 0 THEN 'opendb_id' END)"
_OPEN_SPECS = "CASE folder WHEN 'CPU' THEN 1 WHEN 'RAM' THEN CAST(p_size % 2 = 0 AS INT) WHEN 'Storage' THEN CAST(p_size % 2 = 0 AS INT) WHEN 'PSU' THEN 2 ELSE 1 END"
OPEN_SQL = f"""WITH o AS (SELECT *, {_OPEN_SPECS} AS n_specs, p_size % 3 <> 0 AS has_mpn FROM ({plain_sql(OPEN)}) WHERE folder <> 'Fridge' AND p_size % 13 <> 0 AND p_size % 10 <> 0),
  s AS (SELECT *, least(100, 25 + 15 + CASE WHEN has_mpn THEN 25 ELSE 0 END + least(25, n_specs * 3)) AS completeness FROM o)
  SELECT '00000000-0000-4000-8000-' || digits AS source_record_id, lower(folder) AS category, NULL AS subcategory, p_name AS model, CASE WHEN p_size % 4 <> 0 THEN p_type END AS series,
    {_SLUG('p_name')} || '-00000000' AS slug, CASE WHEN has_mpn THEN 'MP' || p_partkey END AS mpn, NULL AS description, NULL AS short_description,
    CASE WHEN p_size >= 10 THEN make_date(1960 + p_size, 1, 1) END AS release_date, completeness, least(100, {round_sql('78 * 75e-2 + completeness * 25e-2')}) AS confidence,
    NOT has_mpn AS missing_mpn, n_specs = 0 AS missing_specs, NOT has_mpn OR n_specs < 2 AS needs_review, p_name AS name, CASE WHEN has_mpn THEN 'MP' || p_partkey ELSE '' END AS part_numbers,
    n_specs, 'https://maker.example/x' AS source_url, false AS leaks FROM s"""

EXPORT_SQL = f"""WITH e AS (SELECT *, 1 + CAST(s_nationkey > 9 AS INT) AS n_specs FROM ({plain_sql(EXPORT_ROWS)}) WHERE mpn <> '' AND category <> 'fridge'),
  s AS (SELECT *, least(100, 65 + least(20, n_specs * 2) + CASE WHEN image IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN description IS NOT NULL THEN 5 ELSE 0 END) AS completeness FROM e)
  SELECT icecat_id AS source_record_id, category, NULL AS subcategory, name AS model, NULL AS series, {_SLUG('name')} || '-' || substr(sha1('icecat:' || icecat_id), 1, 8) AS slug, mpn, description,
    NULL AS short_description, CAST(NULL AS DATE) AS release_date, completeness, {round_sql('(82 * 3 + completeness) / 4e0')} AS confidence, false AS missing_mpn, false AS missing_specs, false AS needs_review,
    image IS NULL AS missing_image, {fold_sql("concat_ws(' ', name, brand, mpn, '400' || icecat_id)")} AS search_document FROM s"""

ORACLES = {
    "record_codes": f"WITH {_BASE} SELECT record_id, rank, type, value, scope FROM ranked",
    "identity_groups": f"WITH {_BASE} SELECT min(record_id) AS first, count(*) AS records FROM i GROUP BY identity",
    "match_codes": f"WITH {_BASE}, {_MATCH_CODES} SELECT * FROM mc",
    "match_identity": f"WITH {_BASE}, {_MATCH_IDENTITY} SELECT * FROM mi",
    "match_source": f"WITH r AS ({R}) SELECT a.record_id, b.record_id AS component_id FROM r a JOIN r b ON a.source_record_id = b.source_record_id AND b.source_key = 'open'",
    "match_tiers": f"""WITH {_BASE}, {_MATCH_CODES}, {_MATCH_IDENTITY} SELECT record_id, component_id, 'code' AS tier FROM mc
      UNION ALL SELECT record_id, component_id, 'strict_identity' FROM mi WHERE record_id NOT IN (SELECT record_id FROM mc)""",
    "match_reason": f"""WITH {_BASE}, pairs AS ({plain_sql(PAIRS)} UNION {plain_sql(SAME_PAIRS)}),
      hit AS (SELECT left_id, right_id, arg_min(k.type, k.rank) AS type FROM pairs JOIN ranked k ON k.record_id = left_id JOIN ranked q ON q.record_id = right_id AND q.type = k.type AND q.value = k.value AND q.scope = k.scope GROUP BY ALL)
      SELECT p.left_id, p.right_id, CASE WHEN h.type IS NOT NULL THEN 'exact_' || h.type WHEN a.identity = b.identity THEN 'strict_identity' END AS reason
      FROM pairs p JOIN i a ON a.record_id = p.left_id JOIN i b ON b.record_id = p.right_id LEFT JOIN hit h ON h.left_id = p.left_id AND h.right_id = p.right_id""",
    "survive_fields": f"""WITH f AS ({plain_sql(FIELDS)}), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component_id, key, arrival ORDER BY priority DESC, coalesce(text, '') DESC, text IS NULL, source DESC) AS rn FROM f) WHERE rn = 1),
      w AS (SELECT *, row_number() OVER (PARTITION BY component_id, key ORDER BY priority DESC, arrival DESC) AS place FROM d WHERE text <> '')
      SELECT component_id, key, text AS value, source, priority, arrival FROM w WHERE place = 1""",
    "union_part_numbers": """WITH u AS (SELECT l_suppkey, unnest(['N' || CAST(l_partkey % 40 AS VARCHAR), 'M' || CAST(l_linenumber AS VARCHAR)]) AS n FROM lineitem)
      SELECT CAST(l_suppkey AS VARCHAR) AS component_id, string_agg(DISTINCT n, ',' ORDER BY n) AS part_numbers FROM u GROUP BY l_suppkey""",
    "duplicate_pairs": f"""WITH {_GROUPS},
      p AS (SELECT a.id AS x, b.id AS y, a.copies AS cx, b.copies AS cy, len(list_intersect(a.words, b.words)) AS shared, len(a.words) + len(b.words) AS total,
          len(list_filter(a.nums, lambda m: len(list_filter(b.nums, lambda o: starts_with(m, o) OR starts_with(o, m))) > 0)) > 0 AS linked0
        FROM g a JOIN g b ON a.brand = b.brand AND a.id < b.id),
      s AS (SELECT *, coalesce(linked0, false) AS linked, CAST(shared AS DOUBLE) / (total - shared) AS j FROM p),
      t AS (SELECT *, least(99e-2, round(j * 85e-2 + CASE WHEN linked THEN 15e-2 ELSE 0e0 END, 4)) AS score FROM s)
      SELECT x AS left_id, y AS right_id, cx AS left_copies, cy AS right_copies, round(j, 6) AS jaccard, linked, score FROM t WHERE score >= 0.6""",
    "duplicate_copies": f"WITH {_GROUPS} SELECT g.id AS representative, n.record_id, copies, coalesce(r.mpn IS NOT NULL AND n.mpn IS NOT NULL AND (starts_with(n.num, r.num) OR starts_with(r.num, n.num)), false) AS linked, CASE WHEN linked THEN 0.99 ELSE 0.85 END::DOUBLE AS score FROM n JOIN g ON n.brand = g.brand AND n.words = g.words JOIN n r ON r.record_id = g.id WHERE n.record_id <> g.id",
    "prefix_numbers": f"""WITH n AS (SELECT DISTINCT {fold_sql('brand')} AS brand, 'ABCD' || completeness || CASE WHEN confidence > 70 THEN 'X' ELSE '' END AS number FROM ({plain_sql(COMPONENTS)}))
      SELECT a.brand, a.number AS long, b.number AS short FROM n a JOIN n b ON a.brand = b.brand AND starts_with(a.number, b.number)""",
    "normalize_curated": CURATED_SQL,
    "validate_open_db": f"SELECT digits AS file_id, {_OPEN_ERRORS} AS errors FROM ({plain_sql(OPEN)}) WHERE {_OPEN_ERRORS} <> ''",
    "normalize_open_db": OPEN_SQL,
    "normalize_export": EXPORT_SQL,
    "validate_export": f"SELECT icecat_id, concat_ws(',', CASE WHEN category = 'fridge' THEN 'category' END, CASE WHEN mpn = '' THEN 'mpn' END) AS errors FROM ({plain_sql(EXPORT_ROWS)}) WHERE category = 'fridge' OR mpn = ''",
}
QUERIES = {name[2:]: query for name, query in list(globals().items()) if name.startswith("q_")}
