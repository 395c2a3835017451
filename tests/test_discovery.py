"""Triage, links, hardware ids, lanes, promotion, outlines, ranking helpers, quality gate."""

import random

import pytest
from pyspark.sql import functions as F

from gearledger.functions.specs import display, spec_map, text_spec
from gearledger.operators.ranking import carry_forward, round_robin, with_position
from gearledger.plans.discovery import discover_links, hardware_candidates, promote, promote_into, score_hits, triage
from gearledger.plans.outline import import_boards, import_sections
from gearledger.plans.quality import validate

CANDIDATE = "candidate_id string, source_id string, kind string, label string, description string, category string, duplicate boolean"


def test_triage_classes(spark):
    cases = [
        ("AMD Ryzen 5 3600", "", "cpu", "wikidata", "retail-product"), ("GeForce RTX 4070 Ti", "", "gpu", "wikidata", "retail-product"),
        ("Intel Core i7", "famille de processeurs", "cpu", "wikidata", "product-family"), ("Radeon RX 7000", "série de cartes graphiques", "gpu", "wikidata", "product-family"),
        ("AMD Radeon 760M", "integrated GPU", "gpu", "wikidata", "component-model"), ("AMD Ryzen 5 3600", "", "cpu", "pci-ids", "hardware-identifier"),
        ("GeForce Now", "cloud gaming service", "gpu", "wikidata", "false-positive"), ("Widget", "sold online", "gpu", "wikidata", "product-family"),
        ("Core i5-12400F", "a microarchitecture note", "cpu", "wikidata", "retail-product"), ("Thing", "", "gpu", "wikidata", "needs-review"),
    ]
    rows = [(str(i), s, "product-candidate", label, text, c, False) for i, (label, text, c, s, _w) in enumerate(cases)] + [("dup", "wikidata", "k", "AMD Ryzen 5 3600", "", "cpu", True)]
    found = {r.candidate_id: r for r in triage(spark.createDataFrame(rows, CANDIDATE)).collect()}
    assert [found[str(i)].triage for i in range(len(cases))] == [c[4] for c in cases]
    assert found["0"].promotable and not found["dup"].promotable and found["dup"].blocker == "duplicate-identity"
    assert (found["5"].lane, found["6"].lane, found["9"].lane) == ("identifiers", "rejected", "candidates")


def test_search_hits(spark):
    queries = spark.createDataFrame([(1, "gpu", "NVIDIA", "NVIDIA GeForce"), (2, "cooling", "be quiet!", "be quiet Dark Rock")], "query_id int, category string, brand string, query string")
    hits = spark.createDataFrame([
        (1, "Q1", "NVIDIA GeForce RTX 3060", "graphics card"), (1, "Q2", "Museum", "a place"), (1, "Q3", "GeForce", "nvidia"), (1, "Q4", "NVIDIA", "a company"),
        (2, "Q5", "Dark Rock Pro", "be quiet product"), (1, "", " ", "x")], "query_id int, external_id string, label string, description string")
    found = {r.external_id: (r.score, r.confidence) for r in score_hits(hits, queries).collect()}
    # "dark rock" is never found among single words, so the cooler only scores brand and overlap
    assert found == {"Q1": (1.0, "Moyenne"), "Q3": (1.0, "Moyenne"), "Q5": (0.75, "Moyenne")}


def test_round_robin_prefers_few_attempts(spark):
    rows = spark.createDataFrame([("a1", "a", 2), ("a2", "a", 0), ("b1", "b", 0), ("b2", "b", 0)], "id string, source string, attempts int")
    assert [r.id for r in round_robin(rows, "source", ["attempts", "id"], 3).collect()] == ["a2", "b1", "a1"]


def test_carry_forward_over_chunks(spark):
    rng = random.Random(3)
    rows = [(d, i, f"h{i}" if rng.random() < 0.05 else None) for d in ("x", "y") for i in range(200)]
    found = {(r.doc, r.n): r.h for r in carry_forward(spark.createDataFrame(rows, "doc string, n bigint, h string"), ["h"], ["doc"], "n", 7).collect()}
    want, last = {}, {}
    for d, i, h in rows:
        last[d] = h or last.get(d)
        want[d, i] = last[d]
    assert found == want


def test_positions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    found = sorted((r.position, r.v) for r in with_position(rows, [F.desc("v")]).collect())
    assert found == [(i, 999 - i) for i in range(1000)]


def test_links(spark):
    html = """<nav><a href="/about">About</a></nav><!-- <a href="/p/hidden">Hidden product</a> -->
      <a href="/p/one?x=1">Learn more</a> <a href="/p/one"><h3>Board One</h3>now</a> <a href="https://evil.test/p/two">Board Two</a>
      <a href='https://shop.brand.example/p/three'><img alt="Brand Board Three"></a> <a href="http://brand.example/p/four">Four</a> <a href="/p/five">Board Five</a>"""
    pages = spark.createDataFrame([("i", 1, "https://brand.example/list/", html)], "index_id string, page_no int, url string, html string")
    index = spark.createDataFrame([("i", "s", "Brand", "motherboard", ["brand.example"], ["^/p/"], ["board|one"], 2, -1)],
                                  "index_id string, source_id string, brand string, category string, domains array<string>, product_patterns array<string>, label_patterns array<string>, max_candidates int, label_segment int")
    found = {r.url: r.label for r in discover_links(pages, index).collect()}
    assert found == {"https://brand.example/p/one": "Brand Board One", "https://shop.brand.example/p/three": "Brand Board Three"}


def test_unknown_vendor_does_not_inherit(spark):
    lines = ["# head", "10de  NVIDIA", "\t0001  GeForce A", "\t0002  Host bridge", "\t\t1234 5678  GeForce sub", "ffff  Nobody", "\t0003  GeForce B", "1002  AMD", "\t0004  Radeon C", "C 03  Display controller"]
    table = spark.createDataFrame([("f", i, line) for i, line in enumerate(lines)], "path string, line_no bigint, line string")
    vendors = spark.createDataFrame([("10de", "NVIDIA"), ("1002", "AMD")], "vendor_id string, brand string")
    found = {(r.external_id, r.label, r.category) for r in hardware_candidates(table, vendors, chunk_rows=2).collect()}
    assert found == {("10de:0001", "NVIDIA GeForce A", "gpu"), ("1002:0004", "AMD Radeon C", "gpu")}


def test_promotion_gate(spark):
    rows = [("a", "s", "k", "AMD Ryzen 5 3600", "", "cpu", False), ("b", "s", "k", "Thing", "", "cpu", False), ("c", "s", "k", "AMD Ryzen 7 3700", "", "cpu", False)]
    candidates = triage(spark.createDataFrame(rows, CANDIDATE)).withColumns({"external_id": F.col("candidate_id"), "brand": F.lit("AMD")})
    product = F.struct(F.lit("100").alias("reference"), F.lit("Zen 2").alias("series"), F.lit(2019).alias("year"), spec_map({"Socket": text_spec(F.lit("AM4"))}).alias("specs"), F.lit("").alias("notes"), F.lit("").alias("usage"))
    proofs = spark.createDataFrame([("a", "verified", "https://amd.example/a"), ("c", "variant-required", "https://amd.example/c")], "candidate_id string, verification string, official_url string").withColumn("product", product)
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "candidate_id string")
    promoted, refused = promote(asked, candidates, proofs)
    assert {(r.candidate_id, r.refusal) for r in refused.collect()} == {("b", 2), ("c", 3), ("z", 1)}
    row = promoted.first()
    assert row.product_id.startswith("open-amd-ryzen-5-3600-") and row.specs["Source découverte"].s == "s" and row.new_price is None and row.source == "https://amd.example/a"
    assert promote_into(promoted.withColumn("year", F.lit(1)), promoted).collect()[0].year == 2019


def test_board_outline(spark):
    text = ["intro", "ASUS", "AMD AM4 (DDR4)", "B550 (2020) : ASUS Prime B550M (WiFi, AX), TUF", "Gaming B550-I ITX", "Dell : OptiPlex 3050, Vostro", "Z790 : Board Z", "OEM propriétaires", "X99 : Lost", "MSI (gamme)", "Intel LGA 1700 DDR5", "Z790 2023 : Tomahawk MATX"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "doc string, line_no bigint, text string")
    found = import_boards(lines, 3)
    rows = [(r.line_no, r.item_no, r.brand, r.name, r.series, r.socket, r.format, r.ram) for r in found.select(
        "line_no", "item_no", "brand", "name", "series", *[display(F.col("specs")[k]).alias(k.lower()) for k in ("Socket", "Format", "RAM")]).orderBy("line_no", "item_no").collect()]
    assert rows == [
        (3, 0, "ASUS", "ASUS Prime B550M (WiFi, AX)", "B550", "AM4", "À vérifier", "DDR4"), (3, 1, "ASUS", "ASUS TUF Gaming B550-I ITX", "B550", "AM4", "Mini-ITX", "DDR4"),
        (5, 0, "Dell", "Dell OptiPlex 3050", "AMD AM4", "AM4", "À vérifier", "DDR4"), (5, 1, "Dell", "Dell Vostro", "AMD AM4", "AM4", "À vérifier", "DDR4"),
        (6, 0, "Dell", "Dell Board Z", "Z790", "LGA1700", "À vérifier", "DDR4"), (11, 0, "MSI", "MSI Tomahawk MATX", "Z790 2023", "LGA1700", "Micro-ATX", "DDR5"),
    ]


def test_section_outline(spark):
    rows = [
        ("d", 0, "paragraph", "2. Processeurs", []), ("d", 1, "row", "", ["Références", "Détail"]), ("d", 2, "row", "", ["Ryzen 5 1600 / Ryzen 7", "sortie 2017", "AM4"]),
        ("d", 3, "paragraph", "Socket LGA1700 — 2021", []), ("d", 4, "row", "", ["Core i5-12400", ""]), ("d", 5, "paragraph", "5. Mémoire", []), ("d", 6, "row", "", ["Corsair", "Vengeance LPX 2015"]),
        ("d", 7, "paragraph", "11. Annexes", []), ("d", 8, "row", "", ["Ignored", "x"]),
    ]
    found = import_sections(spark.createDataFrame(rows, "doc string, line_no bigint, kind string, text string, cells array<string>"), 2).orderBy("line_no").collect()
    assert [(r.line_no, r.category, r.brand, r.name, r.series, r.year, r.confidence) for r in found] == [
        (2, "cpu", "AMD", "AMD Ryzen 5 1600 et variantes", "2. Processeurs", 2017, "Moyenne"), (4, "cpu", "Intel", "Intel Core i5-12400", "Socket LGA1700", 2021, "Moyenne"),
        (6, "ram", "Corsair", "Corsair Vengeance LPX 2015", "Corsair", 2015, "Faible")]


def test_clean_tables_pass_the_gate(spark):
    rows = [("a", "wiki", "AMD Ryzen 5 3600", "", "cpu", "AMD", "https://w.example/a"), ("b", "wiki", "Thing", "", "gpu", "NVIDIA", "https://w.example/b")]
    candidates = triage(spark.createDataFrame(rows, "candidate_id string, source_id string, label string, description string, category string, brand string, url string").withColumns(
        {"kind": F.lit("k"), "duplicate": F.lit(False), "status": F.lit("À vérifier"), "triage_reason": F.lit("r")}))
    sources = spark.createDataFrame([("wiki", True, "open")], "source_id string, enabled boolean, type string")
    domains = spark.createDataFrame([("AMD", "amd.example")], "brand string, domain string")
    assert validate({"candidates": candidates, "sources": sources, "domains": domains}).collect() == []
    broken = candidates.withColumn("url", F.lit("http://x")).withColumn("promotable", F.lit(True))
    assert {r.rule for r in validate({"candidates": broken, "sources": sources, "domains": domains}).collect()} == {"candidate-url", "promotion-flag"}
    with pytest.raises(ValueError):
        validate({})


def test_candidate_rules_move_no_texts(spark, moved):
    rows = [("a", "wiki", "p", "C:\\x", "cpu", "AMD", "https://amd.example/a", "false-positive", "rejected", "À vérifier", "r", "b", False, False)]
    candidates = spark.createDataFrame(rows, """candidate_id string, source_id string, label string, description string, category string, brand string, url string, triage string,
        lane string, status string, triage_reason string, blocker string, duplicate boolean, promotable boolean""")
    sources = spark.createDataFrame([("wiki", True, "open")], "source_id string, enabled boolean, type string")
    domains = spark.createDataFrame([("AMD", "amd.example")], "brand string, domain string")
    found = validate({"candidates": candidates, "sources": sources, "domains": domains})
    shuffled = moved(found)
    assert any("url" in c for c in shuffled) and not any({"label", "description", "triage_reason"} & set(c) for c in shuffled)
    assert [tuple(r) for r in found.collect()] == [("local-path", "a")]
