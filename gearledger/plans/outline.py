"""Products from printed outlines given as lines tables.

``sections``: lines(doc, line_no, kind, text, cells) where headings announce a category and rows list products.
``boards``: lines(doc, line_no, text) where headings announce a brand and ``key : models`` entries run over lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearledger.functions.identity import document_slug
from gearledger.functions.infer import UNKNOWN, board_format, compact_name, contains_any, infer_brand, infer_socket, ram_generation, split_models
from gearledger.functions.numbers import year_in
from gearledger.functions.specs import spec_map, text_spec
from gearledger.functions.text import clean_printed, squash
from gearledger.operators.ranking import carry_forward, first_wins

# Section numbers and the category each announces; section 11 closes the catalogue.
SECTIONS = (
    ("2.", "cpu"), ("3.", "gpu"), ("4.", "motherboard"), ("5.", "ram"), ("6.", "storage"), ("7.", "psu"), ("8.", "cooling"),
    ("9.", "case"), ("10.", "expansion"),
)
CLOSING = "11."
CONTEXT_WORDS = ("Socket ", "Sockets ", "GeForce ", "Radeon ", "Intel Arc")
TABLE_HEADERS = ("références", "catégorie", "socket", "type", "format", "connecteur", "marque", "thème")

# Headings of the board list.
BRAND_HEADINGS = {
    "ASUS": "ASUS", "MSI": "MSI", "GIGABYTE": "Gigabyte", "ASRock": "ASRock", "BIOSTAR": "Biostar", "Colorful": "Colorful",
    "NZXT": "NZXT", "EVGA": "EVGA", "Supermicro": "Supermicro", "Zotac": "Zotac", "Sapphire": "Sapphire",
}
OEM_HEADINGS = {
    "Dell OptiPlex": "Dell", "HP EliteDesk": "HP", "Lenovo ThinkCentre": "Lenovo", "Fujitsu Esprimo": "Fujitsu",
    "Acer / Foxconn / ECS": "OEM",
}
INLINE_BRANDS = ("Huananzhi", "Machinist", "Jingsha", "Qiyida", "Dell", "HP", "Lenovo", "Fujitsu", "Foxconn", "ECS")
CONTEXT_STARTS = ("AMD AM", "Intel LGA", "Legacy Intel", "Legacy AMD", "GIGABYTE HEDT", "MSI HEDT", "ASRock LGA", "AMD HEDT")
OEM_RESET = "OEM propriétaires"


def _product(lines: DataFrame, category: Column, brand: Column, name: Column, reference: Column, series: Column, year: Column,
             confidence: Column, specs: Column) -> DataFrame:
    brand, name, reference, series = (clean_printed(x) for x in (brand, name, reference, series))
    return lines.select(
        document_slug(F.concat_ws("|", category, brand, name, reference)).alias("product_id"), category.alias("category"),
        F.when(brand == "", UNKNOWN).otherwise(brand).alias("brand"), name.alias("name"),
        F.when(reference == "", name).otherwise(reference).alias("reference"),
        F.when(series == "", UNKNOWN).otherwise(series).alias("series"), year.alias("year"), confidence.alias("confidence"),
        F.lit("Documentaire").alias("status"), specs.alias("specs"), "doc", "line_no", "item_no",
    )


def import_sections(lines: DataFrame, chunk_rows: int = 100_000) -> DataFrame:
    """Product rows of a sectioned outline; section and context headings are carried down to the rows."""
    text = clean_printed(F.col("text"))
    heading = (F.col("kind") == "paragraph") & (text != "")
    numbered = F.lit(None).cast("string")
    for prefix, category in SECTIONS:
        numbered = F.when(text.rlike("^" + prefix.replace(".", "\\.") + "(\\s|$)"), category).otherwise(numbered)
    closing = F.startswith(text, F.lit(CLOSING))
    opens = closing | numbered.isNotNull() | contains_any(text, CONTEXT_WORDS)
    marked = lines.withColumns({
        "category": F.when(heading, F.when(closing, "").otherwise(numbered)),
        "context": F.when(heading & opens, text),
    })
    placed = carry_forward(marked, ["category", "context"], ["doc"], "line_no", chunk_rows)
    cells = F.transform("cells", clean_printed)
    rows = placed.filter((F.col("kind") == "row") & (F.col("category") != "")).withColumn("cells", cells)
    rows = rows.filter(~F.lower(F.get("cells", 0)).isin(*TABLE_HEADERS) & (F.length(F.get("cells", 0)) >= 3))
    detail = F.array_join(F.filter(F.slice("cells", F.lit(2), F.size("cells")), lambda c: c != ""), " · ")
    rows = rows.select("doc", "line_no", "category", F.coalesce("context", F.lit("")).alias("context"),
                       F.get("cells", 0).alias("reference"), detail.alias("detail"), F.lit(0).alias("item_no"))
    known = lambda c: F.when(c == "", UNKNOWN).otherwise(c)
    chips = rows.filter(F.col("category").isin("cpu", "gpu")).withColumns({
        "brand": infer_brand(F.col("category"), F.col("reference"), F.col("context")),
        "series": F.substring(clean_printed(F.regexp_extract("context", "^([^—]*)", 1)), 1, 120),
    })
    first = _product(
        chips, F.col("category"), F.col("brand"), compact_name(F.col("brand"), F.col("reference")), F.col("reference"), F.col("series"),
        year_in(F.concat_ws(" ", "detail", "context")), F.lit("Moyenne"),
        spec_map({"Famille / socket": text_spec(known(F.col("series"))), "Données documentaires": text_spec(known(F.col("detail"))),
                  "Références associées": text_spec(F.col("reference"))}),
    )
    others = rows.filter(F.col("category").isin("ram", "storage", "psu", "cooling", "case", "expansion")).withColumn(
        "brand", F.when(F.col("category").isin("ram", "storage") & (F.size(F.split("reference", "\\s+")) <= 4), F.col("reference")).otherwise(UNKNOWN)
    )
    shown = F.when(F.col("detail") == "", F.col("reference")).otherwise(F.col("detail"))
    second = _product(
        others, F.col("category"), F.col("brand"), compact_name(F.col("brand"), shown), shown, F.col("reference"), year_in(F.col("detail")),
        F.lit("Faible"), spec_map({"Type / famille": text_spec(F.col("reference")), "Références ou caractéristiques": text_spec(known(F.col("detail")))}),
    )
    return first.unionByName(second)


def _start_map(text: Column, table: dict[str, str], whole: bool) -> Column:
    chain = F.lit(None).cast("string")
    for mark, value in reversed(table.items()):
        hit = (text == mark) | F.startswith(text, F.lit(mark + " (")) if whole else F.startswith(text, F.lit(mark))
        chain = F.when(hit, value).otherwise(chain)
    return chain


def import_boards(lines: DataFrame, chunk_rows: int = 100_000) -> DataFrame:
    """Board rows of a brand list; a line that announces nothing continues the entry before it."""
    text = clean_printed(F.col("text"))
    body = lines.withColumn("text", text).filter(F.col("text") != "")
    t = F.col("text")
    brand_mark = F.coalesce(_start_map(t, BRAND_HEADINGS, True), _start_map(t, OEM_HEADINGS, False),
                            F.when(F.startswith(t, F.lit(OEM_RESET)), UNKNOWN))
    context_only = F.lit(False)
    for mark in CONTEXT_STARTS:
        context_only = context_only | F.startswith(t, F.lit(mark))
    inline = F.lit(None).cast("string")
    for mark in reversed(INLINE_BRANDS):
        inline = F.when(F.startswith(t, F.lit(mark + " :")), mark).otherwise(inline)
    key = F.regexp_extract(t, "^([^:]{1,65}?)\\s*:\\s*(.+)$", 1)
    is_key = t.rlike("^[^:]{1,65}\\s*:\\s*.+$") & key.rlike("\\d")
    role = (
        F.when(brand_mark.isNotNull(), "brand").when(context_only, "context").when(inline.isNotNull(), "inline")
        .when(is_key, "entry").otherwise("more")
    )
    marked = body.withColumns({"role": role, "_brand": brand_mark, "_inline": inline, "_key": key}).withColumns({
        "brand": F.when(F.col("role") == "brand", F.col("_brand")).when(F.col("role") == "inline", F.col("_inline")),
        "context": F.when(F.col("role").isin("brand", "context"), F.col("text")),
        "entry": F.when(F.col("role") != "more", F.struct("line_no", "role")),
    })
    placed = carry_forward(marked, ["brand", "context", "entry"], ["doc"], "line_no", chunk_rows)
    placed = placed.filter(F.col("entry.role").isin("entry", "inline") & ((F.col("entry.role") == "entry") | (F.col("role") == "inline")))
    after = F.regexp_extract(t, "^[^:]*:\\s*(.*)$", 1)
    pieces = placed.select(
        "doc", F.col("entry.line_no").alias("line_no"), F.col("line_no").alias("at"), "brand", F.coalesce("context", F.lit("")).alias("context"),
        F.when(F.col("role") == "entry", F.col("_key")).when(F.col("role") == "inline", F.coalesce("context", F.lit("Références"))).alias("key"),
        F.when(F.col("role") == "more", t).otherwise(after).alias("piece"),
    )
    # The lines of one printed entry are put together again.
    entries = pieces.groupBy("doc", "line_no").agg(
        F.max("key").alias("key"), F.min_by("brand", "at").alias("brand"), F.min_by("context", "at").alias("context"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), " ").alias("value"),
    ).filter(F.col("brand").isNotNull() & (F.col("brand") != UNKNOWN))
    cleaned = entries.withColumns({"key": clean_printed(F.col("key")), "value": clean_printed(F.col("value"))}).filter(
        (F.col("key") != "") & (F.col("value") != "")
    )
    models = cleaned.select("doc", "line_no", "key", "brand", "context", F.posexplode(split_models(F.col("value"))).alias("item_no", "model"))
    models = models.withColumn("model", clean_printed(F.regexp_replace("model", "(?i)^(ASUS|BIOSTAR|NZXT)\\s+", "")))
    models = models.filter((F.col("model") != "") & (F.length("model") <= 150) & ~F.lower("model").rlike("^(modèles en circulation|cartes oem)"))
    chipset = clean_printed(F.regexp_extract("key", "^([^(]*)", 1))
    named = F.when(F.contains(F.lower("model"), F.lower("brand")), F.col("model")).otherwise(F.concat_ws(" ", "brand", "model"))
    return _product(
        models, F.lit("motherboard"), F.col("brand"), named, F.col("model"), chipset, F.lit(None).cast("int"), F.lit("Faible"),
        spec_map({"Socket": text_spec(infer_socket(F.col("key"), F.col("context"))), "Chipset / groupe": text_spec(chipset),
                  "Format": text_spec(board_format(F.col("model"))), "RAM": text_spec(ram_generation(F.col("context")))}),
    )


def deduplicate(products: DataFrame) -> DataFrame:
    """First product of each category and squashed name, in document order."""
    keyed = products.withColumn("_name", squash(F.col("name")))
    return first_wins(keyed, ["category", "_name"], ["doc", "line_no", "item_no"]).drop("_name")
