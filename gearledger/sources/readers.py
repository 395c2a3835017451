"""Readers. Every reader takes explicit schemas or parses to VARIANT; a bad file is a row, not a failure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearledger.functions.specs import from_variant
from gearledger.functions.text import unescape_html

EXPORT_FIELDS = (
    "icecat_id string, category string, brand string, mpn string, name string, gtin string, ean string, upc string, "
    "description string, short_description string, specifications map<string,variant>, "
    "images struct<main:string,gallery:array<string>>, source_url string, license string"
)
EXPORT_SCHEMA = EXPORT_FIELDS + ", _corrupt_record string"
PRODUCT_SCHEMA = (
    "product_id string, category string, brand string, name string, reference string, series string, year int, "
    "launch_price double, new_price double, used_price double, performance double, confidence string, status string, "
    "notes string, usage string, source string"
)


def read_open_db(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of a tree with one folder per category and one JSON object per file."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    parsed = files.select(
        F.regexp_extract(name, "([^/]+)/[^/]+$", 1).alias("folder"),
        F.url_decode(F.regexp_extract(name, "([^/]+)\\.json$", 1)).alias("file_id"),
        F.try_parse_json("value").alias("data"),
    )
    broken = F.col("data").isNull()
    return parsed.filter(~broken), parsed.filter(broken).select("folder", "file_id", F.array(F.lit("json")).alias("errors"))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A licensed export: files that hold one JSON array, and files with one object per line, in any mixture.

    The first character of a file that is not blank decides. Text that doesn't parse is a row with ``_corrupt_record``.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    name = F.col("_metadata.file_path").alias("file")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(name, place.alias("place"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    lines = lines.filter(F.trim("value") != "")
    first = lines.groupBy("file").agg(F.min_by(F.substring(F.ltrim("value"), 1, 1), "place").alias("first"))
    arrays = first.filter(F.col("first") == "[").select("file")
    whole = spark.read.text(path, wholetext=True).select(name, "value").join(arrays, "file", "left_semi")
    text = F.regexp_replace("value", "^\ufeff", "")
    parsed = whole.select(text.alias("text"), F.from_json(text, f"array<struct<{EXPORT_FIELDS}>>", options).alias("listed"))
    inside = parsed.filter(F.col("listed").isNotNull()).select(F.inline("listed"))
    broken = parsed.filter(F.col("listed").isNull()).select(F.col("text").alias("_corrupt_record"))
    single = lines.join(arrays, "file", "left_anti").select(F.from_json("value", EXPORT_SCHEMA, options).alias("r")).select("r.*")
    rows = single.unionByName(inside, allowMissingColumns=True).unionByName(broken, allowMissingColumns=True)
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:variant>>"))
    specs = F.transform_values(F.coalesce("specifications", empty), lambda _k, v: from_variant(v))
    raw = F.to_json(F.struct(*[c for c in rows.columns if c != "_corrupt_record"]))
    return rows.withColumn("raw", raw).withColumn("specs", specs).drop("specifications")


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """The curated catalogue: JSON lines with a free ``specs`` object, or Parquet with the tagged map."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    rows = spark.read.schema(PRODUCT_SCHEMA + ", specs map<string,variant>").json(path)
    return rows.withColumn("specs", F.transform_values("specs", lambda _k, v: from_variant(v)))


def read_envelope(spark: SparkSession, path: str, key: str, element: str) -> DataFrame:
    """Rows of the ``key`` array of a versioned JSON document; ``element`` is the DDL of one row."""
    rows = spark.read.schema(f"version int, {key} array<struct<{element}>>").option("multiLine", True).json(path)
    return rows.select("version", F.inline(key))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their place: (path, block, line_no, line).

    ``block`` is the offset of the file split, ``line_no`` orders the lines inside it. A compressed file is one
    split. Lines of one file are ordered by (block, line_no) without numbering the whole file in one task.
    """
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"),
    )


def read_id_database(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a vendor/device text database (plain or gzip) with a global line number per file."""
    from pyspark.sql import Window

    lines = read_lines(spark, path)
    sizes = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("path", "block", "first", "offset")
    return lines.join(offsets, ["path", "block"]).select(
        "path", (F.col("offset") + F.col("line_no") - F.col("first")).alias("line_no"), "line"
    )


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """``<loc>`` texts of sitemap files in document order, whatever the XML namespace prefix."""
    files = spark.read.text(path, wholetext=True)
    element = "<(?:[A-Za-z0-9_]+:)?loc(?:\\s[^>]*)?>((?:[^<]|<!\\[CDATA\\[(?s:.*?)\\]\\]>)*+)</"
    locs = F.regexp_extract_all("value", F.lit(element), F.lit(1))
    found = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(locs).alias("position", "raw"))
    # A CDATA section is taken as it is, other text has character references.
    literal = F.regexp_extract("raw", "(?s)^\\s*<!\\[CDATA\\[(.*?)\\]\\]>\\s*$", 1)
    return found.select("path", "position", F.btrim(F.when(literal != "", literal).otherwise(unescape_html(F.col("raw"))), F.lit(" \t\r\n")).alias("url"))


def read_pages(spark: SparkSession, path: str, columns: Sequence[str] = ("page_id", "url", "html")) -> DataFrame:
    return spark.read.parquet(path).select(*columns)
