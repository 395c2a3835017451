"""Catalogue shapes of the given tables. The text runs unchanged on Spark and on the checking engine."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gearledger.functions.specs import list_spec, number_spec, spec_map, text_spec
from gearledger.session import Scratch, ensure_checkpoint_dir, tasks_for

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Folder:
    """A folder for files, deleted at the end."""

    def __init__(self, spark):
        self.spark, self.path = spark, f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"

    def __enter__(self) -> str:
        return self.path

    def __exit__(self, *_error) -> None:
        Scratch(self.spark)._delete(self.path)


def shape(spark: SparkSession, folder: str, text: str, **given: DataFrame) -> DataFrame:
    """Run shape text in which tables stand in braces; ``given`` tables are not read."""
    names = {n for n in re.findall(r"\{(\w+)\}", text)}
    return spark.sql(text, **{n: given[n] if n in given else table(spark, folder, n) for n in names})


def dealt(spark: SparkSession, folder: str, name: str, key: str, rows: int = 1 << 13) -> DataFrame:
    """A table dealt over tasks of about ``rows`` rows, before anything is made of them: one file may hold all of them."""
    found = table(spark, folder, name)
    return found.repartition(tasks_for(found, rows), key)


def spread(spark: SparkSession, folder: str, text: str, name: str, key: str, rows: int = 1 << 13) -> DataFrame:
    """Rows of shape text dealt over tasks of about ``rows`` rows of table ``name``: one file may hold all of them."""
    return shape(spark, folder, text).repartition(tasks_for(table(spark, folder, name), rows), key)


def plain_sql(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


def pick(expression: str, *values, modulus: int | None = None) -> str:
    """CASE over ``expression % n`` that gives one of the values (None = NULL)."""
    n = modulus or len(values)
    show = lambda v: "NULL" if v is None else (str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'")
    arms = " ".join(f"WHEN {i} THEN {show(v)}" for i, v in enumerate(values))
    return f"CASE {expression} % {n} {arms} END"


def _for(category: int | tuple[int, ...], expression: str) -> str:
    """The expression for parts of the given category number(s), NULL for others."""
    wanted = category if isinstance(category, tuple) else (category,)
    return f"CASE WHEN p_partkey % 9 IN ({', '.join(map(str, wanted))}) THEN {expression} END"


CATEGORY = pick("p_partkey", "cpu", "gpu", "motherboard", "ram", "psu", "case", "storage", "cooling", "expansion")
CPU, GPU, BOARD, RAM, PSU, CASE, STORAGE, COOLING, EXPANSION = range(9)

# column name -> (published field name, kind, SQL)
SPEC_COLUMNS = {
    "socket": ("Socket", "t", _for((CPU, BOARD), pick("p_size", "AM5", "LGA1700", "AM4", "LGA1851", "AM5", "LGA775", None))),
    "architecture": ("Architecture", "t", _for(CPU, pick("p_size", "Zen 4", "Raptor Lake", "Zen 3", "Alder Lake", "Coffee Lake Refresh", None))),
    "chipset": ("Chipset", "t", _for(BOARD, pick("p_size", "B650", "Z790", "B550", "b760", "X870", "Z390", "H999", None))),
    "igpu": ("iGPU", "t", _for(CPU, pick("p_size", "Absent", "UHD 770", "Radeon intégré", None))),
    "cpu_memory": ("Mémoire", "t", _for(CPU, pick("p_size", "DDR4-3200", "DDR5-5600", "DDR4 / DDR5", None))),
    "tdp": ("TDP", "n", _for(CPU, pick("p_size", 65, 125, 105, 95, None, 170))),
    "chipset_ram": ("RAM", "t", _for(BOARD, pick("p_size", "DDR5", "DDR4", "DDR4 / DDR5", None))),
    "slots": ("Slots RAM", "n", _for(BOARD, pick("p_size", 4, 2, None, 4))),
    "ram_max": ("RAM max (Go)", "n", _for(BOARD, pick("p_size", 64, 128, None))),
    "speed_max": ("RAM max (MHz)", "n", _for(BOARD, pick("p_size", 4400, 6000, 5200, None))),
    "ram_type": ("Type", "t", _for(RAM, pick("p_size", "DDR5", "DDR4", "DDR5", None))),
    "sticks": ("Barrettes", "n", _for(RAM, pick("p_size", 2, 4, 1, None))),
    "capacity": ("Capacité", "n", _for((RAM, STORAGE), pick("p_size", 16, 32, 64, 96, 128, None))),
    "speed": ("Fréquence", "n", _for(RAM, pick("p_size", 3200, 3600, 5200, 6000, 7200, None))),
    "profile": ("Profil", "t", _for(RAM, pick("p_size", "XMP 2.0", "EXPO", "XMP / EXPO", "JEDEC", None))),
    "board_format": ("Format", "t", _for(BOARD, pick("p_size", "ATX", "Micro-ATX", "Mini-ITX", None))),
    "case_boards": ("Cartes mères", "l", _for(CASE, pick("p_size", "ATX|Micro-ATX|Mini-ITX", "Mini-ITX", "Micro-ATX|Mini-ITX", None))),
    "gpu_max": ("GPU max (mm)", "n", _for(CASE, pick("p_size", 300, 330, 400, None))),
    "gpu_length": ("Longueur (mm)", "n", _for(GPU, pick("p_size", 242, 290, 320, 336, None))),
    "cooler_max": ("Ventirad max (mm)", "n", _for(CASE, pick("p_size", 155, 165, 180, None))),
    "cooler_height": ("Hauteur (mm)", "n", _for(COOLING, pick("p_size", 152, 157, 165, None, None))),
    "radiator": ("Radiateur (mm)", "n", _for(COOLING, pick("p_size", None, 240, 360, None, 280))),
    "radiators": ("Radiateurs", "t", _for(CASE, pick("p_size", "360 mm, 280 mm", "240 mm", "Aucun", None, "120 / 240"))),
    "psu_format": ("Format", "t", _for(PSU, pick("p_size", "ATX", "SFX", None))),
    "case_psus": ("Formats alimentation", "l", _for(CASE, pick("p_size", "ATX", "SFX|SFX-L", "ATX|SFX", None))),
    "cooler_sockets": ("Sockets compatibles", "l", _for(COOLING, pick("p_size", "AM4|AM5|LGA1700", "LGA1851|LGA1700", "AM4", None))),
    "cooler_class": ("Capacité thermique", "t", _for(COOLING, pick("p_size", "Moyenne", "Élevée", "Très élevée", "Inconnue", None))),
    "watts": ("Puissance", "n", _for(PSU, pick("p_size", 450, 550, 650, 750, 850, None))),
    "gpu_watts": ("Consommation (W)", "n", _for(GPU, pick("p_size", 125, 170, 263, 320, None))),
    "gpu_psu": ("PSU recommandé (W)", "n", _for(GPU, pick("p_size", 450, 550, 700, 750, None))),
    "gpu_plugs": ("Connecteurs", "t", _for(GPU, pick("p_size", "1× 8 broches", "2x 8 broches", "12VHPWR", "1× 8 + 1× 6 broches", "12V-2x6", "Aucun", None))),
    "psu_plug": ("12V-2x6", "t", _for(PSU, pick("p_size", "Non", "12V-2x6", "12VHPWR", None))),
    "psu_pcie": ("PCIe", "t", _for(PSU, pick("p_size", "2× 6+2 broches", "4x 6+2 broches", "1× 6+2", None, "3× 6+2 + 1× 12V-2x6"))),
    "psu_atx3": ("ATX 3.x", "t", _for(PSU, pick("p_size", "Oui", "Non", None))),
    "storage_type": ("Type", "t", _for(STORAGE, pick("p_size", "SSD NVMe", "SSD SATA", "HDD", None))),
    "storage_link": ("Interface", "t", _for(STORAGE, pick("p_size", "PCIe 4.0 x4", "PCIe 5.0 x4", "SATA III", "PCIe 3.0 x4", None))),
    "board_pcie": ("PCIe", "t", _for(BOARD, pick("p_size", "PCIe 5.0 et PCIe 3.0", "PCIe 4.0", "PCIe 3.0", None))),
    "m2": ("Ports M.2", "n", _for(BOARD, pick("p_size", 2, 0, 1, None))),
    "sata": ("Ports SATA", "n", _for(BOARD, pick("p_size", 4, 6, 0, None, 8))),
    "wifi": ("WiFi", "t", _for(BOARD, pick("p_size", "Non", "Wi-Fi 6E", None))),
    "functions": ("Fonctions", "t", _for(EXPANSION, pick("p_size", "Wi-Fi 6 et Bluetooth", "Capture 4K", None))),
    "expansion_link": ("Interface", "t", _for(EXPANSION, pick("p_size", "PCIe x1", "PCIe x4"))),
}

_SPEC_SQL = ",\n  ".join(
    (f"CAST({sql} AS DOUBLE)" if kind == "n" else sql) + f" AS {name}" for name, (_f, kind, sql) in SPEC_COLUMNS.items()
)

PRODUCTS = f"""SELECT p_partkey AS product_id, {CATEGORY} AS category,
  CASE WHEN p_partkey % 9 = 0 THEN {pick('p_size', 'Intel', 'AMD')} ELSE p_brand END AS brand,
  p_name AS name, p_name || ' ' || CAST(p_size AS STRING) AS reference, p_type AS series,
  CASE WHEN p_size % 11 = 0 THEN NULL ELSE 2010 + p_size % 17 END AS year,
  CASE WHEN p_size % 6 = 0 THEN NULL ELSE floor(p_retailprice * 1.4) END AS launch_price,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE floor(p_retailprice * (0.4 + (p_partkey % 10) * 0.12)) END AS new_price,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE floor(p_retailprice * 0.45) END AS used_price,
  CASE WHEN p_size % 13 = 0 THEN NULL ELSE CAST(20 + (p_partkey * 7) % 81 AS DOUBLE) END AS performance,
  {_SPEC_SQL}
FROM {{part}}"""

_DOUBLES = ("launch_price", "new_price", "used_price", "performance")


def products(spark: SparkSession, folder: str, **given: DataFrame) -> DataFrame:
    """Products with the tagged specification map."""
    flat = shape(spark, folder, PRODUCTS, **given)
    makers = {"t": text_spec, "n": number_spec, "l": lambda c: list_spec(F.split(c, "\\|"))}
    entries: dict[str, Column] = {}
    for name, (field, kind, _sql) in SPEC_COLUMNS.items():
        value = makers[kind](F.col(name))
        entries[field] = F.coalesce(entries[field], value) if field in entries else value
    head = ["product_id", "category", "brand", "name", "reference", "series", "year"]
    return flat.select(*head, *[F.col(c).cast("double").alias(c) for c in _DOUBLES], spec_map(entries).alias("specs"))


BUILDS = f"SELECT l_orderkey AS build_id, {pick('l_partkey', 'cpu', 'gpu', 'motherboard', 'ram', 'psu', 'case', 'storage', 'cooling', 'expansion')} AS slot, l_partkey AS product_id FROM {{lineitem}}"

LISTINGS = f"""SELECT l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS listing_id, l_partkey AS product_id,
  floor(l_extendedprice / l_quantity) * 0.25 AS price, CAST(l_suppkey % 20 AS DOUBLE) AS shipping, l_tax * 100 AS protection,
  {pick('(l_linenumber + l_suppkey)', 'sealed', 'like-new', 'excellent', 'good', 'worn', 'untested', 'repair')} AS condition,
  l_linenumber % 2 = 0 AS box, l_returnflag = 'A' AS invoice, l_linestatus = 'O' AS warranty, l_suppkey % 3 = 0 AS tested,
  l_partkey % 4 = 0 AS benchmarks, l_suppkey % 5 = 0 AS professional
FROM {{lineitem}}"""

OBSERVATIONS = "SELECT l_partkey AS product_id, CAST(l_shipdate AS DATE) AS observed_on, floor(l_extendedprice / l_quantity) AS price, l_returnflag AS source FROM {lineitem}"

# Catalogue components: fourteen categories, a size that some records lack, mostly unique part numbers.
COMPONENTS = f"""SELECT CAST(p_partkey AS STRING) AS component_id,
  {pick('p_partkey', 'cpu', 'gpu', 'motherboard', 'ram', 'storage', 'psu', 'case', 'cooling', 'fan', 'network', 'sound_card', 'capture_card', 'monitor', 'thermal_compound')} AS category,
  p_brand AS brand, p_name AS name, p_type AS series,
  CASE WHEN p_size % 6 = 0 THEN NULL ELSE 'MX-' || CAST(p_size AS STRING) || '/' || CAST(p_partkey % 700 AS STRING) END AS mpn,
  CASE WHEN p_size % 9 = 0 THEN NULL ELSE 100000000 + p_partkey % 1500 END AS ean_number,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS capacity,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE {pick('p_size', 'AM5', 'LGA1700', 'AM4')} END AS socket,
  CASE WHEN p_size % 8 = 0 THEN NULL ELSE 2000 + p_size % 25 END AS year,
  25 + p_size % 70 AS completeness, 40 + (p_partkey * 3) % 60 AS confidence,
  p_size % 3 = 0 AS missing_image, p_size % 6 = 0 AS missing_mpn, p_size % 20 = 0 AS missing_specs, p_size % 4 = 0 AS needs_review
FROM {{part}}"""


def components(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue components with a specification map and a search document."""
    from gearledger.functions.text import fold_text

    flat = shape(spark, folder, COMPONENTS)
    specs = spec_map({"capacity": number_spec(F.col("capacity")), "socket": text_spec(F.col("socket"))})
    return flat.select(
        "component_id", "category", "brand", "name", "series", "mpn", F.col("ean_number").cast("string").alias("ean"),
        F.col("capacity").cast("double").alias("capacity"), F.make_date("year", F.lit(1), F.lit(1)).alias("release_date"), "completeness", "confidence",
        "missing_image", "missing_mpn", "missing_specs", "needs_review", specs.alias("specs"),
        fold_text(F.concat_ws(" ", "name", "brand", "series", "mpn", "socket")).alias("search_document"),
    )


# Source records: orders feed components, the priority class is the source.
SOURCES = """SELECT o_orderpriority AS source_key, CAST(o_orderkey AS STRING) AS source_record_id,
  CAST(o_custkey AS STRING) AS component_id FROM {orders}"""
RUNS = """SELECT o_orderpriority AS source_key, o_orderkey AS run_id, o_orderdate AS started_at,
  CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status FROM {orders}"""
DUPLICATES = """SELECT l_partkey AS left_id, l_suppkey AS right_id,
  CASE l_returnflag WHEN 'A' THEN 'pending' WHEN 'R' THEN 'merged' ELSE 'distinct' END AS status FROM {lineitem}"""

# Candidates: documents, the first line is the label and the rest the description.
CANDIDATES = f"""SELECT CAST(doc_id AS STRING) AS candidate_id, source AS source_id, CAST(doc_id AS STRING) AS external_id,
  CASE WHEN source = 'src19' THEN 'hardware-identifier' ELSE 'product-candidate' END AS kind,
  {pick('doc_id', 'AMD Ryzen 5 3600 ', 'NVIDIA GeForce RTX 4070 Ti ', 'Radeon 760M integrated ', '', 'GeForce Now cloud gaming ', 'Samsung 990 Pro ', 'NZXT H510 ', 'Carte série ', '', 'Intel Core i5-12400F ', '')} || text AS text,
  {pick('doc_id', 'cpu', 'gpu', 'motherboard', 'ram', 'psu', 'case', 'storage', 'cooling', 'expansion')} AS category,
  'Maker ' || lang AS brand, 'https://' || source || '.example.com/item/' || CAST(doc_id AS STRING) AS url
FROM {{documents}}"""


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    raw = shape(spark, folder, CANDIDATES)
    return raw.select(
        "candidate_id", "source_id", "external_id", "kind", F.regexp_extract("text", "^([^\\n]*)", 1).alias("label"),
        F.regexp_extract("text", "(?s)^[^\\n]*\\n?(.*)$", 1).alias("description"), "category", "brand", "url",
    )


# The same split in SQL; the label ends at the first line break.
CANDIDATES_SQL = f"""SELECT candidate_id, source_id, external_id, kind, category, brand, url,
  split_part(text, chr(10), 1) AS label,
  CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS description
FROM ({plain_sql(CANDIDATES)})"""


def fold_sql(text: str) -> str:
    """Accent-free lower case words in SQL."""
    return f"trim(regexp_replace(lower(strip_accents({text})), '[^a-z0-9]+', ' ', 'g'))"


def round_sql(value: str) -> str:
    return f"floor(({value}) + 0.5)"
