"""Specification extraction and normalisation on stored pages."""

import pytest
from pyspark.sql import functions as F

from gearledger.functions.specs import display
from gearledger.plans.evidence import parse_pages
from gearledger.plans.specs import extract_specs, missing_fields, normalize_specs


def table(*rows, head=None):
    body = "".join(f"<tr><th>{k}</th><td>{v}</td></tr>" for k, v in rows)
    return f"<table>{body}</table>"


def sku_table(names, *rows):
    head = "".join(f"<th>{n}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def definitions(*rows):
    return "<dl>" + "".join(f"<dt>{k}</dt><dd>{v}</dd>" for k, v in rows) + "</dl>"


def labelled(*rows):
    return "".join(
        f'<li class="spec__item"><div class="spec__label">{k}</div>\n<div class="spec__value">{v}</div></li>' for k, v in rows
    )


def described(text):
    return f'<head><title>Page</title><meta property="og:description" content="{text}"></head>'


JSON_LD = """<script type="application/ld+json">{"@type": "Product", "name": "Ember 550", "additionalProperty": [
 {"name": "Max. Power", "value": "550 W"}, {"name": "Warranty", "value": "3 years"}]}</script>"""

PAGES = {
    "board": ("motherboard", described("Northgate N7.") + table(
        ("Processor Socket", "Socket AM5, second board of its line"), ("Chipset", "AMD X870E"), ("Form Factor", "Micro-ATX"),
        ("Memory Type", "Dual channel DDR5"), ("DIMM Slots", "4"), ("Wireless", "802.11ax radio"), ("Ethernet", "5 GbE port"),
    ) + definitions(("PCI Express", "PCIe 4.0 x16"))),
    "bare": ("motherboard", table(("Chipset", "H610"), ("Form Factor", "Mini-ITX"))),
    "ram": ("ram", definitions(
        ("Memory Type", "DDR5"), ("Kit Capacity", "64GB (4 x 16GB)"), ("Tested Speed", "5200 MHz"), ("Tested Latency", "36-36-36-76"),
        ("Profile", "AMD EXPO"), ("ECC", "On-die ECC"))),
    "sku": ("ram", sku_table(("Part Number", "Capacity", "Colour"), ("Q8", "8GB", "red"), ("Q9", "16GB", "red"), ("Q10", "24GB", "grey"))
            + sku_table(("Memory Type", "Tested Latency", "Tested Speed"), ("DDR4", "CL18", "3600 MHz"))),
    "psu": ("psu", "<ul>" + labelled(
        ("Max. Power", "1000 Watts"), ("Efficiency", "Platinum"), ("Form Factor", "SFX-L"), ("Cable Type", "Semi-modular"),
        ("PCIe Connectors", "2 x PCIe 8-pin"), ("12V-2x6 Connector", "1 x 12VHPWR"), ("Warranty", "7 years")) + "</ul>"),
    "ember": ("psu", JSON_LD),
    "case": ("case", table(
        ("Case Type", "Full tower"), ("Motherboard Compatibility", "E-ATX, ATX"), ("GPU Clearance", "42 cm"),
        ("CPU Cooler Clearance", "below 18.5 cm"), ("Radiator Support", "Top: 420 mm<br>or 360 mm"), ("Dimensions", "58.5 x 25 x 55 cm"))),
    "loop": ("cooling", described("A sealed liquid loop.") + table(
        ("Socket Compatibility", "LGA1700/1851 and TR4"), ("Radiator Size", "240 mm"), ("Fan Quantity", "2 fans"), ("Fan Dimensions", "140 x 140 x 27 mm"))),
    "tower": ("cooling", described("A tower cooler.") + table(("Product Dimensions", "110&times;100&times;148 mm (L&times;W&times;H)"))),
}

EXPECTED = {
    "board": {"socket": "AM5", "chipset": "X870E", "formFactor": "Micro-ATX", "memoryType": "DDR5", "memorySlots": "4",
              "pcie": "PCIe 4.0 x16", "wifi": "Wi-Fi 6", "ethernet": "5GbE"},
    "bare": {"chipset": "H610", "formFactor": "Mini-ITX"},
    "ram": {"memoryType": "DDR5", "capacity": "64", "moduleCount": "4", "speed": "5200", "latency": "36", "expo": "true", "ecc": "On-die ECC"},
    "sku": {"memoryType": "DDR4", "latency": "18", "speed": "3600"},
    "psu": {"wattage": "1000", "efficiency": "80 PLUS Platinum", "atxStandard": "SFX-L", "modularity": "Semi-modulaire",
            "pcieConnectors": "2", "highPowerConnector": "12VHPWR", "warrantyYears": "7"},
    "ember": {"wattage": "550", "warrantyYears": "3"},
    "case": {"caseFormFactor": "Full Tower", "motherboardSupport": "E-ATX, ATX", "maxGpuLength": "420", "maxCoolerHeight": "185",
             "radiators": "420 mm, 360 mm", "dimensions": "585 × 250 × 550 mm"},
    "loop": {"coolerType": "AIO", "sockets": "LGA1700, LGA1851, TR4", "radiatorSize": "240", "fanCount": "2", "fanSize": "140"},
    "tower": {"coolerType": "Air", "coolerHeight": "148", "dimensions": "110 × 100 × 148 mm"},
}
MISSING = {
    "board": [], "bare": ["socket", "memoryType", "memorySlots", "pcie", "wifi", "ethernet"], "ram": ["xmp"],
    "loop": ["coolerHeight", "dimensions"], "tower": ["sockets", "radiatorSize", "fanCount", "fanSize"],
}


@pytest.fixture(scope="module")
def extracted(spark):
    pages = spark.createDataFrame([(k, f"<html>{h}</html>") for k, (_c, h) in PAGES.items()], "candidate_id string, html string")
    categories = spark.createDataFrame([(k, c) for k, (c, _h) in PAGES.items()], "candidate_id string, category string")
    raw = extract_specs(pages, "candidate_id").join(categories, "candidate_id").cache()
    specs = normalize_specs(raw).cache()
    return raw, specs, categories


def test_values_of_every_page(extracted):
    _raw, specs, _ = extracted
    found = {}
    for r in specs.withColumn("shown", display(F.col("spec"))).collect():
        found.setdefault(r.candidate_id, {})[r.field] = r.shown
    assert found == EXPECTED


def test_absent_fields_are_missing_not_negative(extracted):
    _raw, specs, categories = extracted
    found = {r.candidate_id: r.missing for r in missing_fields(categories, specs).collect()}
    for page, fields in MISSING.items():
        assert found[page] == fields


def test_raw_evidence_and_confidence(extracted):
    _raw, specs, _ = extracted
    rows = {(r.candidate_id, r.field): r for r in specs.collect()}
    socket = rows["board", "socket"]
    assert (socket.raw_field, socket.raw_value) == ("Processor Socket", "Socket AM5, second board of its line")
    assert (socket.method, socket.confidence) == ("spec-table", "medium")
    assert {rows[k].method for k in rows if k[0] == "ember"} == {"json-ld"}
    assert {rows[k].method for k in rows if k[0] == "ram"} == {"definition-list"}
    assert (rows["loop", "coolerType"].method, rows["loop", "coolerType"].confidence) == ("meta", "low")
    assert rows["ember", "wattage"].unit == "W"


def test_table_of_several_references_is_skipped(extracted):
    raw, _specs, _ = extracted
    names = [r.field for r in raw.filter("candidate_id = 'sku'").orderBy("row_no").collect()]
    assert names == ["Memory Type", "Tested Latency", "Tested Speed"]
    assert {r.method for r in raw.filter("candidate_id = 'psu'").collect()} == {"spec-list"}


def test_single_rows(spark):
    rows = [
        ("off", "motherboard", "WLAN", "none", "spec-table"),
        ("one", "ram", "Profile", "XMP 2.0 ready", "json-ld"),
        ("sides", "cooling", "Radiator Dimensions", "277×120×27 mm(L×W×H)", "spec-table"),
        ("told", "cooling", "og:description", "A liquid cooler of 240 mm for AM4.", "meta"),
        ("huge", "psu", "Power", "7200 W", "spec-table"),
    ]
    raw = spark.createDataFrame(rows, "candidate_id string, category string, field string, value string, method string").withColumn("row_no", F.lit(0))
    found = {(r.candidate_id, r.field, r.shown, r.confidence) for r in
             normalize_specs(raw).withColumn("shown", display(F.col("spec"))).collect()}
    assert ("off", "wifi", "false", "high") in found
    assert [f for f in found if f[0] == "one"] == [("one", "xmp", "XMP 2.0", "medium")]
    assert not [f for f in found if f[0] == "sides" and f[1] == "radiatorSize"]
    assert [f[1] for f in found if f[0] == "told"] == ["coolerType"]
    assert not [f for f in found if f[0] == "huge"]


def test_repeated_rows_and_limit(spark):
    page = table(*[(f"Field {i}", f"value {i}") for i in range(90)], ("field 1", "VALUE 1"))
    pages = spark.createDataFrame([("p", page)], "page_id string, html string")
    rows = extract_specs(pages, limit=80).orderBy("row_no").collect()
    assert len(rows) == 80 and rows[0].field == "Field 0"
    assert extract_specs(pages).count() == 90


NESTED = {
    # A value that is a table itself is one value; the table around it goes on behind it.
    "table in a cell": ("<table><tr><th>Ports</th><td>rear <table><tr><td>4 x</td><td> USB</td></tr></table>, 2 front</td></tr><tr><th>Weight</th><td>3 kg</td></tr></table>",
                        [("Ports", "rear 4 x USB, 2 front", "spec-table"), ("Weight", "3 kg", "spec-table")]),
    "four deep": ("<table><tr><td>A</td><td>" + "<table><tr><td>" * 3 + "x" + "</td></tr></table>" * 3 + "</td></tr><tr><td>B</td><td>y</td></tr></table>",
                  [("A", "x", "spec-table"), ("B", "y", "spec-table")]),
    # A table between the rows of another is a table of its own, read where it ends.
    "table between rows": ("<table><tr><td>A</td><td>1</td></tr><table><tr><td>C</td><td>3</td></tr></table><tr><td>B</td><td>2</td></tr></table>",
                           [("C", "3", "spec-table"), ("A", "1", "spec-table"), ("B", "2", "spec-table")]),
    "list in a value": ("<dl><dt>Fans</dt><dd><dl><dt>Front</dt><dd>3</dd></dl> in all</dd><dt>Slots</dt><dd>7</dd></dl>",
                        [("Fans", "Front3 in all", "definition-list"), ("Slots", "7", "definition-list")]),
    "nested value": ('<div class="label">Size</div><div class="value"><div>240 <div>mm</div></div></div><div class="label">Pump</div><div class="value"><ul><li>a</li><li>b</li></ul></div>',
                     [("Size", "240 mm", "spec-list"), ("Pump", "a, b", "spec-list")]),
    "table in a value": ('<p class="label">Board</p><section class="value"><table><tr><td>ATX</td><td> only</td></tr></table></section>', [("Board", "ATX only", "spec-list")]),
    "list in a cell": ("<table><tr><td>Case</td><td><dl><dt>w</dt><dd>20</dd></dl></td></tr></table>", [("Case", "w20", "spec-table")]),
    "tags left open": ("<table><tr><th>A<td>1<tr><th>B<td>2</table><dl><dt>C<dd>3<dt>D<dd>4</dl>",
                       [("A", "1", "spec-table"), ("B", "2", "spec-table"), ("C", "3", "definition-list"), ("D", "4", "definition-list")]),
    "closed too often": ("</table></dl></div><table><tr><td>A</td><td>1 &lt; 2</td></tr></table></table><table><tr><td>B</td><td>2</td></tr></table>",
                         [("A", "1 < 2", "spec-table"), ("B", "2", "spec-table")]),
    "never closed": ('<div class="label">A</div><div class="value">1<table><tr><td>B</td><td>2</td></tr></table>', [("B", "2", "spec-table")]),
    "head of a nested table": ("<table><tr><td>A</td><td><table><thead><tr><th>q</th><th>r</th><th>s</th></tr></thead></table></td></tr><tr><td>B</td><td>2</td></tr></table>",
                               [("A", "qrs", "spec-table"), ("B", "2", "spec-table")]),
    "long value": ("<table><tr><td>" + "N" * 200 + "</td><td>" + "v" * 9000 + "</td></tr></table>", [("N" * 200, "v" * 9000, "spec-table")]),
    "empty": ("", []), "no html": (None, []),
}


def test_nested_markup(spark):
    pages = spark.createDataFrame([(name, html) for name, (html, _) in NESTED.items()], "page_id string, html string")
    found = {name: [] for name in NESTED}
    for r in extract_specs(pages).orderBy("page_id", "row_no").collect():
        found[r.page_id].append((r.field, r.value, r.method))
    assert found == {name: rows for name, (_, rows) in NESTED.items()}


def ld(text):
    return f'<script type="application/ld+json">{text}</script>'


def deep(levels, inner):
    return '{"@type": "Thing", "z": [' * levels + inner + "]}" * levels


def test_json_ld_at_any_depth_in_document_order(spark):
    named = '{"@type": "Product", "name": "%s", "additionalProperty": {"name": "Rank %s", "value": "%s"}}'
    pages = {
        "deep": ld(deep(50, named % ("Far", "a", "1"))),
        # The keys are not in alphabetical order, and the deeper product stands first.
        "order": ld('{"z": {"y": ' + named % ("First", "b", "2") + '}, "a": ' + named % ("Second", "c", "3") + "}"),
        "unnamed": ld('{"@type": ["x", "https://schema.org/ProductModel"], "sku": "s1"}') + ld(named % ("Later", "d", "4")),
        "braces": ld('{"k": "} ] \\" {", "@graph": [' + named % ('{\\"q\\": 1}', "e", "5") + "]}"),
        "broken": ld("{not json") + ld(named % ("Good", "f", "6")),
        "list": ld("[" + ", ".join(named % (f"P{i}", f"g{i}", i) for i in range(3)) + "]"),
        "none": "<p>No data</p>",
    }
    frame = spark.createDataFrame(list(pages.items()), "url string, html string")
    parsed = {r.url: r for r in parse_pages(frame).collect()}
    title = {u: r.page_title for u, r in parsed.items()}
    assert title == {"deep": "Far", "order": "First", "unnamed": "Later", "braces": '{"q": 1}', "broken": "Good", "list": "P0", "none": ""}
    assert not parsed["none"].structured and parsed["order"].properties[0].name == "Rank b"
    rows = {}
    for r in extract_specs(frame, "url").orderBy("url", "row_no").collect():
        rows.setdefault(r.url, []).append((r.field, r.value))
    assert rows == {"deep": [("Rank a", "1")], "order": [("Rank b", "2"), ("Rank c", "3")], "unnamed": [("Rank d", "4")], "braces": [("Rank e", "5")],
                    "broken": [("Rank f", "6")], "list": [(f"Rank g{i}", str(i)) for i in range(3)]}


# (category, published name, published text, field, value, confidence)
PUBLISHED = [
    ("motherboard", "Socket", "LGA 1700", "socket", "LGA1700", "high"), ("motherboard", "Socket", "am5", "socket", "AM5", "high"),
    ("motherboard", "Socket", "AMD AM3+ / AM3", "socket", "AM3+", "medium"), ("motherboard", "Socket", "program4", "socket", None, None),
    ("cooling", "Sockets", "LGA 1851/1700/115", "sockets", "LGA1851, LGA1700, LGA115", "high"), ("cooling", "Sockets", "Intel LGA1851/1700, AMD sTRX4, AM5 and AM4", "sockets", "LGA1851, LGA1700, sTRX4, AM5, AM4", "medium"),
    ("cooling", "Sockets", "1700/1851", "sockets", None, None),
    ("motherboard", "Chipset", "X870E", "chipset", "X870E", "high"), ("motherboard", "Chipset", "AMD TRX40 board", "chipset", "TRX40", "medium"),
    ("motherboard", "Chipset", "ROG-Z790-A", "chipset", "Z790", "medium"), ("motherboard", "Chipset", "zz790 ab550c2", "chipset", None, None),
    ("motherboard", "Expansion Slots", "1 x PCIe 5.0 x16, 2x PCI Express 4 x4, PCI-E gen 3", "pcie", "1× PCIe 5.0 x16, 2× PCIe 4.0 x4, PCIe 3.0", "medium"),
    ("motherboard", "PCIe", "PCIe x16", "pcie", "PCIe x16", "high"), ("motherboard", "PCIe", "PCI Express", "pcie", None, None),
    ("motherboard", "Wireless", "Wi-Fi 6E", "wifi", "Wi-Fi 6E", "high"), ("motherboard", "Wireless", "IEEE 802.11be", "wifi", "Wi-Fi 7", "medium"),
    ("motherboard", "Wireless", "Sans fil", "wifi", "true", "high"), ("motherboard", "Wireless", "aucun", "wifi", "false", "high"), ("motherboard", "Wireless", "antenna", "wifi", None, None),
    ("ram", "XMP", "XMP3.0", "xmp", "XMP 3.0", "high"), ("ram", "EXPO", "AMD EXPO", "expo", "true", "medium"), ("ram", "EXPO", "exposure", "expo", None, None),
    ("ram", "ECC", "Non-ECC", "ecc", "false", "high"), ("ram", "ECC", "on die ECC memory", "ecc", "On-die ECC", "medium"), ("ram", "ECC", "ECC", "ecc", "true", "high"),
    ("psu", "Efficiency", "80 PLUS Gold", "efficiency", "80 PLUS Gold", "high"), ("psu", "Efficiency", "80+ plus platinum certified", "efficiency", "80 PLUS Platinum", "medium"),
    ("psu", "Efficiency", "titanium", "efficiency", "80 PLUS Titanium", "high"), ("psu", "Efficiency", "80 plus", "efficiency", "80 PLUS", "high"), ("psu", "Efficiency", "gold plated", "efficiency", None, None),
    ("psu", "Standard", "ATX12V 2.52", "atxStandard", "ATX12V 2.52", "high"), ("psu", "Standard", "ATX12V 2.4", "atxStandard", "ATX12V 2.4", "high"), ("psu", "Standard", "ATX 3.1", "atxStandard", "ATX 3.1", "high"),
    ("psu", "Standard", "SFX-L", "atxStandard", "SFX-L", "high"), ("psu", "Standard", "flex ATX", "atxStandard", "Flex ATX", "high"), ("psu", "Standard", "micro-ATX", "atxStandard", None, None),
    ("psu", "PCIe Connectors", "2 x PCIe 8-pin, 4 x PCI-E cable 6+2 pin", "pcieConnectors", "6", "medium"), ("psu", "PCIe Connectors", "PCIe 8 pin", "pcieConnectors", "1", "high"),
    ("psu", "PCIe Connectors", "PCIe, 8 pin", "pcieConnectors", None, None),
    ("case", "Dimensions", "58.5 x 25,5 x 55 cm", "dimensions", "585 × 255 × 550 mm", "high"), ("case", "Dimensions", "300mm x 215mm x 474mm (LxWxH)", "dimensions", "300 × 215 × 474 mm", "medium"),
    ("case", "Dimensions", "300 x 215 mm", "dimensions", None, None),
    ("cooling", "Height", "120 x 110 x 158 mm (L x W x H)", "coolerHeight", "158", "medium"), ("cooling", "Height", "120 x 110 x 158 mm", "coolerHeight", None, None), ("cooling", "Height", "158 mm", "coolerHeight", "158", "high"),
    ("cooling", "Radiator", "277 x 120 x 27 mm", "radiatorSize", None, None), ("cooling", "Radiator Size", "360 mm", "radiatorSize", "360", "high"),
]


def test_published_texts(spark):
    rows = [(i, c, 0, name, text, "spec-table") for i, (c, name, text, *_rest) in enumerate(PUBLISHED)]
    raw = spark.createDataFrame(rows, "candidate_id int, category string, row_no int, field string, value string, method string")
    found = {(r.candidate_id, r.field): (r.shown, r.confidence) for r in normalize_specs(raw).withColumn("shown", display(F.col("spec"))).collect()}
    wrong = {PUBLISHED[i][:4]: found.get((i, f)) for i, (_c, _n, _t, f, shown, sure) in enumerate(PUBLISHED) if found.get((i, f), (None, None)) != (shown, sure)}
    assert wrong == {}


def test_tasks_grow_with_the_pages_and_rows(spark, monkeypatch):
    """The tasks that open pages up, and those that parse rows, are as many as the input needs, whatever the session's number."""
    from gearledger.operators import markup
    from gearledger.plans import specs as jobs

    made = [(str(i), f"<table><tr><th>Max. Power</th><td>{400 + i} W</td></tr></table><dl><dt>Efficiency</dt><dd>80 PLUS Gold</dd></dl>"
             f"<script type='application/ld+json'>{{\"@type\": \"Product\", \"additionalProperty\": [{{\"name\": \"Warranty\", \"value\": \"{i % 9 + 1} years\"}}]}}</script>") for i in range(60)]
    pages = spark.createDataFrame(made, "candidate_id string, html string")
    parts = lambda df: df.select(F.spark_partition_id()).distinct().count()
    monkeypatch.setattr(markup, "SHARE", 1000)
    monkeypatch.setattr(jobs, "ROWS", 9)
    laid = markup.layout_rows(pages, "candidate_id").withColumn("part", F.spark_partition_id()).collect()
    assert len(laid) == 120 and len({r.part for r in laid}) > 4
    raw = spark.createDataFrame([(str(i), "psu", 0, "Max. Power", f"{400 + i} W", "spec-table") for i in range(60)],
                                "candidate_id string, category string, row_no int, field string, value string, method string")
    assert parts(normalize_specs(raw)) > 4


def test_summary_query_gives_every_section(spark, tmp_path):
    """Values by confidence are part of the summary, zeros included."""
    from gearledger.catalogue_queries.specs import QUERIES

    parts = [(5 * i, f"part {i}", "Brand#1", "TYPE", i, 1.0) for i in range(1, 9)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    rows = {(r.section, r.name): (r.records, r["values"]) for r in QUERIES["spec_summary"](spark, str(tmp_path)).collect()}
    levels = {n: v for (section, n), (_records, v) in rows.items() if section == "confidence"}
    assert set(levels) == {"high", "medium", "low"} and levels["low"] == 0 and levels["high"] > 0 and levels["medium"] > 0
    assert sum(levels.values()) == rows["total", "normalized"][1] == rows["category", "motherboard"][1]
    assert rows["category", "motherboard"][0] == 8 and rows["category", "psu"] == (0, 0)
