"""Compatibility audit, summaries, comparison, recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearledger.catalogue_queries.shapes import BUILDS, PRODUCTS, SPEC_COLUMNS, plain_sql, products, round_sql, shape
from gearledger.functions.numbers import connector_count
from gearledger.model.dimensions import BUILD_HEADLINE, CHIPSET_SUPPORT, CPU_FAMILIES, HEADLINE, OTHER_SECTION, SPEC_SECTIONS
from gearledger.operators.catalogue import grouped_specs, headline_specs, lookup_products
from gearledger.operators.statistics import numeric_keys
from gearledger.plans import comparison
from gearledger.plans.compatibility import build_summary, build_verdict, check_builds, resolve_builds, verdict_from_checks

SELECTIONS = "SELECT l_orderkey AS comparison_id, l_partkey AS product_id, min(l_linenumber * 1000000 + l_partkey) AS position FROM {lineitem} GROUP BY l_orderkey, l_partkey"
REQUESTS = """SELECT o_orderkey AS request_id, floor(o_totalprice / 250) AS budget,
  CASE o_orderstatus WHEN 'O' THEN '1080p' WHEN 'F' THEN '1440p' ELSE '4K' END AS resolution, o_orderpriority = '1-URGENT' AS compact FROM {orders}"""
# Three starter builds made of the cheapest product of each category of a brand group.
STARTERS = f"""SELECT starter AS build_id, category AS slot, min(product_id) AS product_id FROM (
  SELECT product_id, category, CASE WHEN new_price < 700 THEN 'am4-budget' WHEN new_price < 1200 THEN 'itx-compact' ELSE 'am5-1440p' END AS starter
  FROM ({PRODUCTS}) p WHERE new_price IS NOT NULL) t GROUP BY starter, category"""


def _inputs(spark, folder):
    return shape(spark, folder, BUILDS), products(spark, folder)


def q_check_builds(spark, folder):
    return check_builds(*_inputs(spark, folder)).drop("position", "basis")


def q_build_verdict(spark, folder):
    return build_verdict(*_inputs(spark, folder))


def q_verdict_from_checks(spark, folder):
    return verdict_from_checks(check_builds(*_inputs(spark, folder)))


def q_build_summary(spark, folder):
    return build_summary(*_inputs(spark, folder))


def q_resolve_builds(spark, folder):
    """Product of each slot, the way the audit sees it."""
    wide = resolve_builds(*_inputs(spark, folder))
    return wide.select("build_id", *[F.col(s)["product_id"].alias(s) for s in ("cpu", "gpu", "motherboard", "ram", "psu", "case", "storage", "cooling", "expansion")])


def q_lookup_products(spark, folder):
    """Products by id, the expensive half from the main table and the rest from the fallback."""
    rows = products(spark, folder).select("product_id", "name", "new_price")
    main, rest = rows.filter(F.col("new_price") > 700), rows.withColumn("name", F.concat(F.lit("fallback "), "name"))
    ids = shape(spark, folder, BUILDS).select("product_id").distinct()
    return lookup_products(ids, main, rest)


def q_compare_best(spark, folder):
    rows = comparison.compared(shape(spark, folder, SELECTIONS), products(spark, folder))
    return comparison.best_flags(rows)


def q_comparison_matrix(spark, folder):
    rows = comparison.compared(shape(spark, folder, SELECTIONS), products(spark, folder))
    return comparison.comparison_matrix(rows).drop("first_seen")


def q_comparison_order(spark, folder):
    """Keys of each comparison in the order in which the compared products first show them."""
    rows = comparison.compared(shape(spark, folder, SELECTIONS), products(spark, folder))
    found = comparison.comparison_matrix(rows)
    seen = found.groupBy("comparison_id", F.col("first_seen.place").alias("place")).agg(F.array_sort(F.collect_list(F.struct("first_seen.at", "key"))).alias("keys"))
    return seen.select("comparison_id", "place", F.array_join(F.array_sort(F.transform("keys", lambda k: k["key"])), ",").alias("keys"))


def q_recommend(spark, folder):
    requests = shape(spark, folder, REQUESTS).withColumn("budget", F.col("budget").cast("double"))
    found = comparison.recommend(requests, shape(spark, folder, STARTERS), products(spark, folder))
    return found.select("request_id", "starter", "total", "verdict", "over_budget")


def q_headline_specs(spark, folder):
    return headline_specs(products(spark, folder), HEADLINE)


def q_build_headline_specs(spark, folder):
    return headline_specs(products(spark, folder), BUILD_HEADLINE)


def q_grouped_specs(spark, folder):
    return grouped_specs(products(spark, folder), SPEC_SECTIONS, OTHER_SECTION)


def q_numeric_keys(spark, folder):
    rows = products(spark, folder).select("brand", F.explode("specs").alias("key", "spec")).select("brand", "key", F.col("spec.kind").alias("kind"))
    return numeric_keys(rows, ["brand"])


def q_connector_count(spark, folder):
    """Number of plugs written in a text, over all published connector texts."""
    rows = products(spark, folder).select("product_id", F.coalesce(F.col("specs")["Connecteurs"], F.col("specs")["PCIe"])["s"].alias("published"))
    return rows.select("product_id", connector_count(F.col("published")).alias("plugs"))


P, B = plain_sql(PRODUCTS), plain_sql(BUILDS)
SLOTS = ("cpu", "gpu", "motherboard", "ram", "psu", "case", "storage", "cooling", "expansion")
ALIAS = {"case": "box", "motherboard": "mb"}
_name = lambda s: ALIAS.get(s, s)

_FLAT = lambda c: f"lower(strip_accents({c}))"
_FAMILY = "CASE " + _FLAT("cpu.architecture") + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CPU_FAMILIES.items()) + " END"


def _support(side: int) -> str:
    return "CASE upper(mb.chipset) " + " ".join(
        f"WHEN '{k}' THEN '|" + "|".join(v[side]) + "|'" for k, v in CHIPSET_SUPPORT.items()) + " END"


_DIGITS = lambda c: f"list_transform(regexp_extract_all(coalesce({c}, ''), '[0-9]+'), lambda x: CAST(x AS DOUBLE))"
_COUNT = lambda c: f"CASE WHEN {c} IS NOT NULL THEN coalesce(list_sum(list_transform(regexp_extract_all({c}, '([0-9]+)\\s*[xX×]', 1), lambda x: CAST(x AS DOUBLE))), 0) END"
_GEN = lambda c: f"list_max(list_transform(regexp_extract_all(coalesce({c}, ''), '([3-6])\\.0', 1), lambda x: CAST(x AS INT)))"
_HAS = lambda lst, v: f"list_contains(string_split({lst}, '|'), {v})"
_PEAK = round_sql("cpu.tdp * 1.35")
_DRAW = f"(coalesce({_PEAK}, 0) + coalesce(gpu.gpu_watts, 0) + 85)"
_MODERN = "(coalesce(gpu.gpu_plugs, '') ILIKE '%12vhpwr%' OR coalesce(gpu.gpu_plugs, '') ILIKE '%12v-2x6%')"
_PROFILE = "lower(coalesce(ram.profile, ''))"


def _verdict(inputs: str, good: str, bad: str) -> str:
    missing = " OR ".join(f"{c} IS NULL" for c in inputs.split(";"))
    return f"CASE WHEN {missing} THEN 'unknown' WHEN {good} THEN 'ok' ELSE '{bad}' END"


def _margin(room: str, need: str, thin: int) -> str:
    return f"CASE WHEN {room} IS NULL OR {need} IS NULL THEN 'unknown' WHEN {room} - {need} < 0 THEN 'error' WHEN {room} - {need} < {thin} THEN 'warning' ELSE 'ok' END"


def _in(*slots: str) -> str:
    return " AND ".join(f"{_name(s)}.product_id IS NOT NULL" for s in slots)


_RULES = [
    ("Plateforme", "socket", _in("cpu", "motherboard"), _verdict("cpu.socket;mb.socket", "cpu.socket = mb.socket", "error")),
    ("Plateforme", "chipset", _in("cpu", "motherboard"),
     f"CASE WHEN {_FAMILY} IS NULL OR {_support(0)} IS NULL THEN 'unknown' WHEN contains({_support(0)}, '|' || {_FAMILY} || '|') THEN 'ok' WHEN contains({_support(1)}, '|' || {_FAMILY} || '|') THEN 'warning' ELSE 'error' END"),
    ("Plateforme", "display-output", _in("cpu") + " AND gpu.product_id IS NULL", _verdict("cpu.igpu", "lower(cpu.igpu) <> 'absent'", "error")),
    ("Mémoire", "ram-type", _in("ram", "motherboard"), _verdict("ram.ram_type;mb.chipset_ram", "contains(mb.chipset_ram, ram.ram_type)", "error")),
    ("Mémoire", "ram-slots", _in("ram", "motherboard"), _verdict("ram.sticks;mb.slots", "ram.sticks <= mb.slots", "error")),
    ("Mémoire", "ram-capacity", _in("ram", "motherboard"), _verdict("ram.capacity;mb.ram_max", "ram.capacity <= mb.ram_max", "error")),
    ("Mémoire", "ram-speed", _in("ram", "motherboard"), _verdict("ram.speed;mb.speed_max", "ram.speed <= mb.speed_max", "warning")),
    ("Mémoire", "ram-controller", _in("ram", "cpu") + f" AND ram.speed IS NOT NULL AND list_max({_DIGITS('cpu.cpu_memory')}) > 1000",
     f"CASE WHEN ram.speed <= list_max({_DIGITS('cpu.cpu_memory')}) THEN 'ok' ELSE 'info' END"),
    ("Mémoire", "ram-profile", _in("ram", "cpu") + f" AND ({_PROFILE} LIKE '%xmp%' OR {_PROFILE} LIKE '%expo%')",
     f"CASE WHEN ({_PROFILE} LIKE '%expo%' AND {_PROFILE} NOT LIKE '%xmp%' AND cpu.brand = 'Intel') OR ({_PROFILE} LIKE '%xmp%' AND {_PROFILE} NOT LIKE '%expo%' AND cpu.brand = 'AMD') THEN 'warning' ELSE 'ok' END"),
    ("Intégration", "case-format", _in("motherboard", "case"), _verdict("mb.board_format;box.case_boards", _HAS("box.case_boards", "mb.board_format"), "error")),
    ("Intégration", "gpu-length", _in("gpu", "case"), _margin("box.gpu_max", "gpu.gpu_length", 15)),
    ("Intégration", "cooler-height", _in("cooling", "case") + " AND (cooling.cooler_height IS NOT NULL OR box.cooler_max IS NOT NULL)", _margin("box.cooler_max", "cooling.cooler_height", 5)),
    ("Intégration", "radiator-mount", _in("cooling", "case") + " AND cooling.radiator IS NOT NULL",
     f"CASE WHEN len({_DIGITS('box.radiators')}) = 0 THEN 'unknown' WHEN list_contains({_DIGITS('box.radiators')}, cooling.radiator) THEN 'ok' ELSE 'error' END"),
    ("Intégration", "psu-format", _in("psu", "case"), _verdict("psu.psu_format;box.case_psus", _HAS("box.case_psus", "psu.psu_format"), "error")),
    ("Refroidissement", "cooler-socket", _in("cooling", "cpu"), _verdict("cooling.cooler_sockets;cpu.socket", _HAS("cooling.cooler_sockets", "cpu.socket"), "error")),
    ("Refroidissement", "cooler-capacity", _in("cooling", "cpu"),
     f"CASE WHEN cpu.tdp IS NULL OR coalesce({_FLAT('cooling.cooler_class')}, '') NOT IN ('moyenne', 'elevee', 'tres elevee') THEN 'unknown' WHEN CASE {_FLAT('cooling.cooler_class')} WHEN 'moyenne' THEN 130 WHEN 'elevee' THEN 200 ELSE 280 END >= {_PEAK} * 1.15 THEN 'ok' ELSE 'warning' END"),
    ("Refroidissement", "cooler-missing", _in("cpu") + " AND cooling.product_id IS NULL", "'unknown'"),
    ("Alimentation", "psu-power", _in("psu"), f"CASE WHEN psu.watts IS NULL THEN 'unknown' WHEN psu.watts < gpu.gpu_psu THEN 'error' WHEN psu.watts < {_DRAW} * 1.25 THEN 'warning' ELSE 'ok' END"),
    ("Alimentation", "psu-connectors", _in("psu", "gpu"),
     f"CASE WHEN gpu.gpu_plugs IS NULL THEN 'unknown' WHEN {_MODERN} THEN CASE WHEN psu.psu_plug <> 'Non' THEN 'ok' ELSE 'warning' END WHEN psu.psu_pcie IS NULL THEN 'unknown' WHEN {_COUNT('psu.psu_pcie')} >= {_COUNT('gpu.gpu_plugs')} THEN 'ok' ELSE 'error' END"),
    ("Alimentation", "psu-atx3", _in("psu", "gpu") + f" AND {_MODERN} AND psu.psu_atx3 IS NOT NULL", "CASE WHEN psu.psu_atx3 = 'Oui' THEN 'ok' ELSE 'warning' END"),
    ("Stockage", "m2-port", _in("storage", "motherboard") + " AND lower(storage.storage_type) LIKE '%nvme%'", _verdict("mb.m2", "mb.m2 >= 1", "error")),
    ("Stockage", "m2-generation", _in("storage", "motherboard") + f" AND lower(storage.storage_type) LIKE '%nvme%' AND {_GEN('storage.storage_link')} IS NOT NULL AND {_GEN('mb.board_pcie')} IS NOT NULL",
     f"CASE WHEN {_GEN('storage.storage_link')} <= {_GEN('mb.board_pcie')} THEN 'ok' ELSE 'info' END"),
    ("Stockage", "sata-port", _in("storage", "motherboard") + " AND lower(storage.storage_type) LIKE '%sata%'", _verdict("mb.sata", "mb.sata >= 1", "error")),
    ("Plateforme", "wifi", _in("motherboard") + " AND mb.wifi = 'Non' AND lower(coalesce(expansion.functions, '')) NOT LIKE '%wi-fi%'", "'info'"),
    ("Plateforme", "expansion-slot", _in("expansion", "motherboard"), "CASE WHEN mb.board_pcie IS NOT NULL THEN 'info' ELSE 'unknown' END"),
]


def _wide(builds: str = B) -> str:
    ids = ", ".join(f"min(CASE WHEN slot = '{s}' THEN product_id END) AS {s}_id" for s in SLOTS)
    joins = " ".join(f"LEFT JOIN p {_name(s)} ON w.{s}_id = {_name(s)}.product_id" for s in SLOTS)
    return f"p AS (SELECT * FROM ({P})), w AS (SELECT build_id, {ids} FROM ({builds}) GROUP BY build_id)", joins


def _checks(builds: str = B) -> str:
    head, joins = _wide(builds)
    rules = " UNION ALL ".join(f'SELECT build_id, \'{g}\' AS "group", \'{r}\' AS rule, {status} AS status FROM w {joins} WHERE {when}' for g, r, when, status in _RULES)
    return f"{head}, r AS ({rules}), c AS (SELECT * FROM r UNION ALL SELECT build_id, 'Plateforme', 'empty', 'unknown' FROM w WHERE build_id NOT IN (SELECT build_id FROM r))"


_VERDICT = """SELECT build_id, CASE WHEN count(*) = 1 AND max(rule) = 'empty' THEN 'unknown' WHEN count(*) FILTER (status = 'error') > 0 THEN 'error'
  WHEN count(*) FILTER (status = 'warning') > 0 THEN 'warning' WHEN count(*) FILTER (status = 'unknown') > 0 OR count(*) FILTER (status = 'ok') = 0 THEN 'unknown' ELSE 'ok' END AS verdict,
  """ + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in ("ok", "warning", "error", "unknown", "info")) + " FROM c GROUP BY build_id"

CHECKS_SQL = f'WITH {_checks()} SELECT build_id, "group", rule, status FROM c'
VERDICT_SQL = f"WITH {_checks()} {_VERDICT}"


def _summary(builds: str = B) -> str:
    head, joins = _wide(builds)
    n = [_name(s) for s in SLOTS]
    total = " + ".join(f"coalesce({x}.new_price, {x}.used_price, 0)" for x in n)
    priced = " + ".join(f"CAST(({x}.new_price IS NOT NULL OR {x}.used_price IS NOT NULL) AS INT)" for x in n)
    parts = " + ".join(f"CAST({x}.product_id IS NOT NULL AS INT)" for x in n)
    draw = "(coalesce(gpu.gpu_watts, 0) + coalesce(cpu.tdp, 0) * 135e-2 + 85)"
    cp, gp = "nullif(cpu.performance, 0)", "nullif(gpu.performance, 0)"
    return f"""WITH {head} SELECT build_id, {total} AS total, {priced} AS priced, {parts} AS parts, {round_sql(draw)} AS estimated,
      ceil({draw} * 135e-2 / 50) * 50 AS recommended, {round_sql(f'{cp} * 35e-2 + {gp} * 65e-2')} AS gaming, {round_sql(f'{cp} * 9e-1')} AS application,
      CASE WHEN {cp} IS NULL OR {gp} IS NULL THEN 'À vérifier' WHEN abs({cp} - {gp}) <= 15 THEN 'Équilibré' WHEN {cp} > {gp} THEN 'GPU limitant probable' ELSE 'CPU limitant possible' END AS balance
      FROM w {joins}"""


RESOLVED_SQL = f"WITH {_wide()[0]} SELECT build_id, " + ", ".join(f'{s}_id AS "{s}"' for s in SLOTS) + " FROM w"
LOOKUP_SQL = f"""WITH p AS (SELECT product_id, name, new_price FROM ({P})) SELECT p.product_id, CASE WHEN new_price > 700 THEN name ELSE 'fallback ' || name END AS name, new_price
  FROM p WHERE product_id IN (SELECT l_partkey FROM lineitem)"""

_COMPARED = f"""j AS (SELECT s.comparison_id, s.position, p.* FROM ({plain_sql(SELECTIONS)}) s JOIN ({P}) p ON s.product_id = p.product_id),
  f AS (SELECT *, arg_min(category, position) OVER (PARTITION BY comparison_id) AS lead FROM j),
  k AS (SELECT *, row_number() OVER (PARTITION BY comparison_id ORDER BY position) AS place FROM f WHERE category = lead),
  c AS (SELECT * FROM k WHERE place <= 4)"""
_SCORE = f"CASE WHEN performance <> 0 AND coalesce(used_price, new_price) <> 0 THEN {round_sql('performance / coalesce(used_price, new_price) * 100')} END"
BEST_SQL = f"""WITH {_COMPARED}, s AS (SELECT *, {_SCORE} AS value_score FROM c)
  SELECT comparison_id, product_id, place, performance, value_score,
    coalesce(performance = max(performance) OVER (PARTITION BY comparison_id), false) AS best_performance,
    coalesce(value_score = max(value_score) OVER (PARTITION BY comparison_id), false) AS best_value FROM s"""

_FIELDS = {}
for _column, (_field, _kind, _sql) in SPEC_COLUMNS.items():
    _FIELDS.setdefault((_field), []).append((_column, _kind))


def _shown(column: str, kind: str) -> str:
    if kind == "n":
        return f"CAST(CAST({column} AS BIGINT) AS VARCHAR)"
    return f"replace({column}, '|', ', ')" if kind == "l" else column


LONG = " UNION ALL ".join(
    f"SELECT product_id, category, brand, '{field}' AS key, {_shown(column, kind)} AS shown, {'true' if kind == 'n' else 'false'} AS is_number FROM p WHERE {column} IS NOT NULL"
    for field, columns in _FIELDS.items() for column, kind in columns
)
MATRIX_SQL = f"""WITH {_COMPARED}, p AS (SELECT * FROM ({P})), l AS ({LONG})
  SELECT comparison_id, l.key, bool_and(is_number) AS numeric, """ + ", ".join(f"max(CASE WHEN place = {i} THEN shown END) AS p{i}" for i in range(1, 5)) + """
  FROM c JOIN l ON c.product_id = l.product_id GROUP BY comparison_id, l.key"""

_STARTER_BUILDS = plain_sql(STARTERS)
RECOMMEND_SQL = f"""WITH v AS (WITH {_checks(_STARTER_BUILDS)} {_VERDICT}), s AS ({_summary(_STARTER_BUILDS)}),
  q AS (SELECT *, CASE WHEN compact THEN 'itx-compact' WHEN budget <= 900 THEN 'am4-budget' WHEN budget <= 1400 AND resolution = '1080p' THEN 'itx-compact' ELSE 'am5-1440p' END AS starter FROM ({plain_sql(REQUESTS)}))
  SELECT request_id, starter, total, verdict, total > budget AS over_budget FROM q LEFT JOIN s ON q.starter = s.build_id LEFT JOIN v ON q.starter = v.build_id"""


def _headline_sql(table: dict) -> str:
    rows = ", ".join(f"('{c}', '{k}', {i})" for c, keys in table.items() for i, k in enumerate(keys))
    return f"""WITH p AS (SELECT * FROM ({P})), l AS ({LONG}), h AS (SELECT * FROM (VALUES {rows}) t(category, key, pos))
  SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY pos) - 1 AS position, l.key, shown FROM l JOIN h ON l.category = h.category AND l.key = h.key"""


_SECTIONS = ", ".join(
    f"('{c}', '{k}', {g}, '{title}', {i})" for c, groups in SPEC_SECTIONS.items() for g, (title, keys) in enumerate(groups) for i, k in enumerate(keys))
GROUPED_SQL = f"""WITH p AS (SELECT * FROM ({P})), l AS ({LONG}), h AS (SELECT * FROM (VALUES {_SECTIONS}) t(category, key, g, title, pos))
  SELECT product_id, coalesce(g, 99) AS section_no, coalesce(title, '{OTHER_SECTION}') AS section, coalesce(pos, 0) AS position, l.key, shown
  FROM l LEFT JOIN h ON l.category = h.category AND l.key = h.key"""
NUMERIC_SQL = f"WITH p AS (SELECT * FROM ({P})), l AS ({LONG}) SELECT brand, key, bool_and(is_number) AS numeric FROM l GROUP BY brand, key"
PLUGS_SQL = f"SELECT product_id, {_COUNT('coalesce(gpu_plugs, psu_pcie, board_pcie)')} AS plugs FROM ({P})"

QUERIES = {
    "check_builds": q_check_builds, "build_verdict": q_build_verdict, "verdict_from_checks": q_verdict_from_checks,
    "build_summary": q_build_summary, "resolve_builds": q_resolve_builds, "lookup_products": q_lookup_products,
    "compare_best": q_compare_best, "comparison_matrix": q_comparison_matrix, "comparison_order": q_comparison_order, "recommend": q_recommend,
    "headline_specs": q_headline_specs, "build_headline_specs": q_build_headline_specs, "grouped_specs": q_grouped_specs,
    "numeric_keys": q_numeric_keys, "connector_count": q_connector_count,
}
ORACLES = {
    "check_builds": CHECKS_SQL, "build_verdict": VERDICT_SQL, "verdict_from_checks": VERDICT_SQL, "build_summary": _summary(),
    "resolve_builds": RESOLVED_SQL, "lookup_products": LOOKUP_SQL, "compare_best": BEST_SQL, "comparison_matrix": MATRIX_SQL,
    "comparison_order": f"""WITH {_COMPARED}, p AS (SELECT * FROM ({P})), l AS ({LONG}), s AS (SELECT comparison_id, l.key, min(place) AS place FROM c JOIN l ON c.product_id = l.product_id GROUP BY comparison_id, l.key)
      SELECT comparison_id, place, string_agg(key, ',' ORDER BY key) AS keys FROM s GROUP BY comparison_id, place""",
    "recommend": RECOMMEND_SQL, "headline_specs": _headline_sql(HEADLINE), "build_headline_specs": _headline_sql(BUILD_HEADLINE),
    "grouped_specs": GROUPED_SQL, "numeric_keys": NUMERIC_SQL, "connector_count": PLUGS_SQL,
}
