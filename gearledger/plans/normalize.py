"""Source records to canonical records: open database, curated catalogue, licensed export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearledger.functions import identity, scores
from gearledger.functions.numbers import release_date
from gearledger.functions.specs import flat_text, from_variant
from gearledger.functions.text import fold_text
from gearledger.functions.urls import https_only
from gearledger.model import literal_map
from gearledger.model.dimensions import CATALOGUE_TO_PRODUCT, OPEN_FOLDERS, OPEN_RESERVED_KEYS, OPEN_SPEC_KEYS

# Source key, priority and confidence of each kind of source.
CURATED, OPEN_DB, EXPORT = "curated", "open_db", "export"
CURATED_PRIORITY, OPEN_PRIORITY, EXPORT_PRIORITY = 90, 70, 60
OPEN_CONFIDENCE, EXPORT_CONFIDENCE = 78, 82
CURATED_CONFIDENCE = {"Bonne": 92, "Moyenne": 72}
CURATED_CONFIDENCE_ELSE = 50
NO_REFERENCE = "À vérifier"
OPEN_LICENSE = "ODC-By-1.0"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

COLUMNS = (
    "record_id", "read_order", "source_key", "source_record_id", "priority", "source_confidence", "category", "subcategory",
    "brand", "manufacturer", "model", "series", "name", "slug", "mpn", "part_numbers", "gtin", "ean", "upc", "description",
    "short_description", "release_date", "discontinued", "media_main", "media_gallery", "specs", "source_url",
    "source_license", "raw", "identity_hash", "codes", "completeness", "confidence", "missing_image", "missing_mpn",
    "missing_specs", "needs_review", "search_document",
)


def _text(value=None) -> Column:
    return F.lit(value).cast("string")


def search_document(specs: Column, *parts: Column) -> Column:
    """Folded text of the given parts, the part numbers and all specification values."""
    values = F.array_join(F.transform(F.map_values(specs), flat_text), " ")
    return fold_text(F.concat_ws(" ", *parts, values))


def _finish(df: DataFrame) -> DataFrame:
    df = df.withColumns({
        "record_id": identity.record_id(F.col("source_key"), F.col("source_record_id")),
        "identity_hash": identity.identity_hash(F.col("brand"), F.col("name"), F.col("category"), F.col("specs")),
        "codes": identity.codes(F.col("part_numbers"), F.col("brand"), F.col("gtin"), F.col("ean"), F.col("upc")),
        "missing_image": F.col("media_main").isNull(),
        "missing_mpn": F.size("part_numbers") == 0,
        "missing_specs": F.size("specs") == 0,
    })
    return df.select(*COLUMNS)


def _open_errors(folder: Column, data: Column) -> Column:
    get = lambda path, kind: F.try_variant_get(data, path, kind)
    kind = lambda path: F.schema_of_variant(get(path, "variant"))
    text = lambda path: kind(path) == "STRING"
    optional = lambda path: get(path, "variant").isNull() | kind(path).isin("STRING", "VOID")
    year = get("$.metadata.releaseYear", "variant")
    rules = {
        "category": ~folder.isin(*OPEN_FOLDERS),
        "json": data.isNull(),
        "opendb_id": ~F.coalesce(text("$.opendb_id") & get("$.opendb_id", "string").rlike(UUID), F.lit(False)),
        "name": ~F.coalesce(text("$.metadata.name") & (get("$.metadata.name", "string") != ""), F.lit(False)),
        "manufacturer": ~F.coalesce(text("$.metadata.manufacturer") & (get("$.metadata.manufacturer", "string") != ""), F.lit(False)),
        "part_numbers": get("$.metadata.part_numbers", "variant").isNotNull() & ~F.coalesce(
            kind("$.metadata.part_numbers").startswith("ARRAY"), F.lit(False)),
        "series": ~optional("$.metadata.series"),
        "variant": ~optional("$.metadata.variant"),
        "release_year": year.isNotNull() & F.schema_of_variant(year).isin("BOOLEAN") | F.schema_of_variant(year).rlike("^(ARRAY|OBJECT)"),
    }
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])
    return F.filter(found, lambda e: e.isNotNull())


def validate_open_db(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, refused) records; refused ones carry the names of all rules they break.

    ``records``: folder, file_id, data (VARIANT or null for a file that is not JSON).
    """
    checked = records.withColumn("errors", _open_errors(F.col("folder"), F.col("data")))
    valid = checked.filter(F.size("errors") == 0).drop("errors")
    refused = checked.filter(F.size("errors") > 0).select("folder", "file_id", "errors")
    return valid, refused


def project_specs(folder: Column, data: Column) -> Column:
    """Specification map of an open database record: the folder's own keys, or all but the reserved ones."""
    values = F.try_variant_get(data, "$", "map<string,variant>")
    allowed = F.create_map(*[
        x for name, keys in OPEN_SPEC_KEYS.items() for x in (F.lit(name), F.array(*[F.lit(k) for k in keys]))
    ])[folder]
    kept = F.map_filter(
        values, lambda k, _v: F.when(allowed.isNotNull(), F.array_contains(allowed, k)).otherwise(~k.isin(*OPEN_RESERVED_KEYS))
    )
    return F.transform_values(kept, lambda _k, v: from_variant(v))


def sanitize_raw(data: Column) -> Column:
    """JSON of a record whose general product block keeps the manufacturer URL only."""
    values = F.try_variant_get(data, "$", "map<string,variant>")

    def clean(key: Column, value: Column) -> Column:
        inner = F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, _v: k == "manufacturer_url")
        nested = F.schema_of_variant(value).startswith("OBJECT") & (key == "general_product_information")
        return F.when(nested, F.parse_json(F.to_json(inner))).otherwise(value)

    return F.to_json(F.transform_values(values, clean))


def normalize_open_db(records: DataFrame) -> DataFrame:
    """Canonical records of the valid open database records."""
    get = lambda path, kind="string": F.try_variant_get(F.col("data"), path, kind)
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    numbers = F.array_distinct(F.filter(
        F.transform(F.coalesce(get("$.metadata.part_numbers", "array<string>"), F.array().cast("array<string>")), lambda n: F.trim(n)),
        lambda n: n != "",
    ))
    folder = F.col("folder")
    category = literal_map({k: v[0] for k, v in OPEN_FOLDERS.items()})[folder]
    order = F.array_position(F.array(*[F.lit(k) for k in OPEN_FOLDERS]), folder)
    base = records.select(
        F.concat_ws("|", F.lpad(order.cast("string"), 3, "0"), "file_id").alias("read_order"),
        F.lit(OPEN_DB).alias("source_key"), get("$.opendb_id").alias("source_record_id"),
        F.lit(OPEN_PRIORITY).alias("priority"), F.lit(OPEN_CONFIDENCE).alias("source_confidence"),
        category.alias("category"),
        literal_map({k: v[1] for k, v in OPEN_FOLDERS.items() if v[1]})[folder].alias("subcategory"),
        F.trim(get("$.metadata.manufacturer")).alias("brand"), F.trim(get("$.metadata.manufacturer")).alias("manufacturer"),
        F.coalesce(filled(get("$.metadata.variant")), F.trim(get("$.metadata.name"))).alias("model"),
        filled(get("$.metadata.series")).alias("series"), F.trim(get("$.metadata.name")).alias("name"),
        F.get(numbers, 0).alias("mpn"), numbers.alias("part_numbers"),
        _text().alias("gtin"), _text().alias("ean"), _text().alias("upc"),
        _text().alias("description"), _text().alias("short_description"),
        release_date(get("$.metadata.releaseYear")).alias("release_date"), F.lit(False).alias("discontinued"),
        _text().alias("media_main"), F.array().cast("array<string>").alias("media_gallery"),
        project_specs(folder, F.col("data")).alias("specs"),
        https_only(get("$.general_product_information.manufacturer_url")).alias("source_url"),
        F.lit(OPEN_LICENSE).alias("source_license"), sanitize_raw(F.col("data")).alias("raw"),
    )
    slug_name = fold_text(F.col("name"))
    slug = F.concat(
        F.when(slug_name == "", "composant").otherwise(F.substring(F.regexp_replace(slug_name, " ", "-"), 1, 160)),
        F.lit("-"), F.substring("source_record_id", 1, 8),
    )
    count = F.size("specs")
    scored = base.withColumns({
        "slug": slug,
        "completeness": scores.completeness_open(F.col("brand"), F.col("part_numbers"), count, F.col("media_main"), F.col("description")),
        "needs_review": scores.needs_review(F.col("part_numbers"), count),
        "search_document": search_document(
            F.col("specs"), F.col("name"), F.col("brand"), F.col("model"), F.col("series"), F.array_join("part_numbers", " ")),
    })
    return _finish(scored.withColumn("confidence", scores.confidence_open(F.col("source_confidence"), F.col("completeness"))))


def normalize_curated(products: DataFrame) -> DataFrame:
    """Canonical records of curated products."""
    c = F.col
    mpn = F.when((c("reference") != "") & (c("reference") != NO_REFERENCE), c("reference"))
    category = literal_map({**{k: k for k in CATALOGUE_TO_PRODUCT}, "expansion": "network"})[c("category")]
    trust = F.when(c("confidence") == "Bonne", CURATED_CONFIDENCE["Bonne"]).when(
        c("confidence") == "Moyenne", CURATED_CONFIDENCE["Moyenne"]).otherwise(CURATED_CONFIDENCE_ELSE)
    key = c("product_id").cast("string")
    base = products.select(
        key.alias("read_order"), F.lit(CURATED).alias("source_key"), key.alias("source_record_id"),
        F.lit(CURATED_PRIORITY).alias("priority"), trust.alias("source_confidence"), category.alias("category"),
        F.when(c("category") == "expansion", "expansion").alias("subcategory"),
        "brand", c("brand").alias("manufacturer"), c("name").alias("model"), F.nullif("series", F.lit("")).alias("series"), "name",
        identity.suffixed_slug(c("name"), key).alias("slug"), mpn.alias("mpn"),
        F.when(mpn.isNotNull(), F.array(mpn)).otherwise(F.array().cast("array<string>")).alias("part_numbers"),
        _text().alias("gtin"), _text().alias("ean"), _text().alias("upc"),
        F.nullif("notes", F.lit("")).alias("description"), F.nullif("usage", F.lit("")).alias("short_description"),
        F.when(c("year") != 0, F.make_date(c("year"), F.lit(1), F.lit(1))).alias("release_date"), F.lit(False).alias("discontinued"),
        _text().alias("media_main"), F.array().cast("array<string>").alias("media_gallery"), "specs",
        c("source").alias("source_url"), F.lit("proprietary").alias("source_license"),
        F.to_json(F.struct(key.alias("id"), "category", "reference")).alias("raw"),
    )
    count = F.size("specs")
    scored = base.withColumns({
        "completeness": scores.completeness_curated(c("mpn"), count),
        "needs_review": scores.needs_review(c("part_numbers"), count),
        "search_document": search_document(
            c("specs"), c("name"), c("brand"), F.coalesce(F.get_json_object("raw", "$.reference"), F.lit("")), c("series")),
    })
    return _finish(scored.withColumn("confidence", scores.confidence_blend(c("source_confidence"), c("completeness"))))


def validate_export(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, refused) rows of a licensed export: five filled texts, a known category, https pictures optional."""
    filled = lambda n: F.coalesce(F.col(n) != "", F.lit(False))
    rules = {n: ~filled(n) for n in ("icecat_id", "brand", "mpn", "name", "license")}
    rules["category"] = ~F.coalesce(F.col("category").isin(*CATALOGUE_TO_PRODUCT), F.lit(False))
    if "_corrupt_record" in rows.columns:
        rules["json"] = F.col("_corrupt_record").isNotNull()
    found = F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]), lambda e: e.isNotNull())
    checked = rows.withColumn("errors", found)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def normalize_export(rows: DataFrame) -> DataFrame:
    """Canonical records of valid export rows. ``specs`` is the tagged map, ``images`` a struct of main and gallery."""
    c = F.col
    base = rows.select(
        c("icecat_id").alias("read_order"), F.lit(EXPORT).alias("source_key"), c("icecat_id").alias("source_record_id"),
        F.lit(EXPORT_PRIORITY).alias("priority"), F.lit(EXPORT_CONFIDENCE).alias("source_confidence"), "category",
        _text().alias("subcategory"), "brand", c("brand").alias("manufacturer"), c("name").alias("model"), _text().alias("series"),
        "name", identity.suffixed_slug(c("name"), F.concat(F.lit("icecat:"), c("icecat_id"))).alias("slug"),
        "mpn", F.array("mpn").alias("part_numbers"), "gtin", "ean", "upc", "description", "short_description",
        F.lit(None).cast("date").alias("release_date"), F.lit(False).alias("discontinued"),
        c("images.main").alias("media_main"), F.coalesce("images.gallery", F.array().cast("array<string>")).alias("media_gallery"),
        "specs", "source_url", c("license").alias("source_license"), "raw",
    )
    count = F.size("specs")
    scored = base.withColumns({
        "completeness": scores.completeness_export(count, c("media_main"), c("description")),
        "needs_review": F.lit(False),
        "search_document": fold_text(F.concat_ws(" ", "name", "brand", "mpn", "gtin", "ean", "upc")),
    })
    return _finish(scored.withColumn("confidence", scores.confidence_blend(c("source_confidence"), c("completeness"))))
