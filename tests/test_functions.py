"""Column expressions against plain Python."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from gearledger.functions import identity, infer, numbers, scores, specs, text, urls


def run(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def python_fold(value):
    kept = "".join(c for c in unicodedata.normalize("NFKD", value) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub(r"[^a-z0-9]+", " ", kept.lower()).strip()


WORDS = ["Élevée", "Série à l’œuvre", "ASUS ROG Strix  B550-F", "Ünïcödé", "été", "", "  --- ", "ＡＢＣ１２", "x² × 3", "Größe", "Ñandú Łódź"]


def test_fold_text(spark):
    assert run(spark, "v string", [(w,) for w in WORDS], text.fold_text(F.col("v"))) == [python_fold(w) for w in WORDS]


def test_fold_exact_expands_ligatures(spark):
    words = ["ﬁn", "½ ton", *WORDS]
    assert run(spark, "v string", [(w,) for w in words], text.fold_exact(F.col("v"))) == [python_fold(w) for w in words]


def test_identifier(spark):
    found = run(spark, "v string", [("cmk32gx4-m2",), ("é-12/a",), (None,), ("ｍｚ９",)], text.normalize_identifier(F.col("v")))
    assert found == ["CMK32GX4M2", "12A", "", "MZ9"]


def test_slugs(spark):
    found = run(spark, "v string", [("Intel Core i5 6400",), ("***",), ("a" * 200,)], text.slugify(F.col("v")))
    assert found == ["intel-core-i5-6400", "composant", "a" * 160]
    seed = hashlib.sha1(b"s:e").hexdigest()[:8]
    assert run(spark, "v string", [("AMD Ryzen 5 – é",)], identity.promoted_slug(F.col("v"), F.lit("s"), F.lit("e"))) == [f"open-amd-ryzen-5-e-{seed}"]


def test_candidate_key(spark):
    want = "candidate-" + hashlib.sha1(b"wikidata:Q1:gpu").hexdigest()[:16]
    assert run(spark, "v int", [(1,)], identity.candidate_key(F.lit("wikidata"), F.lit("Q1"), F.lit("gpu"))) == [want]


def test_identity_hash_is_stable_and_discriminates(spark):
    made = specs.spec_map({"capacity": specs.number_spec(F.col("n")), "socket": specs.text_spec(F.col("s"))})
    rows = [(2000.0, "LGA 1151"), (2000.0, "LGA 1151"), (4000.0, "LGA 1151"), (None, None)]
    found = run(spark, "n double, s string", rows, identity.identity_hash(F.lit("Samsung"), F.lit("990 PRO"), F.lit("storage"), made))
    parts = ["capacity:2000", "memory:null", "modules:null", "wattage:null", 'socket:"LGA 1151"', "chipset:null", "form_factor:null", "screen_size:null"]
    assert found[0] == hashlib.sha256(("samsung|990 pro|storage|" + "|".join(parts)).encode()).hexdigest()
    assert found[0] == found[1] and len(set(found)) == 3


def test_rounding_is_half_up(spark):
    assert run(spark, "v double", [(2.5,), (-2.5,), (0.49,), (-0.5,)], numbers.js_round(F.col("v"))) == [3.0, -2.0, 0.0, 0.0]


def test_figures_in_text(spark):
    rows = [("2× 8 broches",), ("1x 8 + 1x 6",), ("3× PCIe + 12V-2x6",), ("aucun",), (None,)]
    assert run(spark, "v string", rows, numbers.connector_count(F.col("v"))) == [2.0, 2.0, 5.0, 0.0, None]
    assert run(spark, "v string", [("PCIe 3.0 et 5.0",), ("SATA",), (None,)], numbers.pcie_generation(F.col("v"))) == [5.0, None, None]
    dates = run(spark, "v string", [("2015",), ("1969",), ("2015.5",), ("x",), (None,)], numbers.release_date(F.col("v")))
    assert [str(d) if d else None for d in dates] == ["2015-01-01", None, None, None, None]


def test_value_score_needs_both_sides(spark):
    rows = [(90.0, 100.0, 200.0), (90.0, None, 200.0), (0.0, 100.0, None), (90.0, None, None), (90.0, 0.0, 100.0), (None, 1.0, 1.0)]
    found = run(spark, "p double, u double, n double", rows, scores.value_score(F.col("p"), F.col("u"), F.col("n")))
    assert found == [90.0, 45.0, None, None, None, None]


def test_power_model(spark):
    rows = [(120.0, 263.0), (65.0, None), (None, None)]
    assert run(spark, "t double, g double", rows, scores.system_draw(F.col("t"), F.col("g"))) == [510.0, 173.0, 85.0]


@pytest.mark.parametrize("url,domains,want", [
    ("https://www.brand.example/a", ["brand.example"], True), ("https://brand.example", ["Brand.example"], True),
    ("https://notbrand.example/", ["brand.example"], False), ("https://brand.example.evil.test/", ["brand.example"], False), ("", ["a"], False),
    ("https://user@brand.example:8443/x", ["brand.example"], True),
])
def test_trusted_domain(spark, url, domains, want):
    assert run(spark, "u string, d array<string>", [(url, domains)], urls.in_domains(F.col("u"), F.col("d"))) == [want]


def test_links_and_labels(spark):
    base = "https://Shop.example/en/index.html"
    rows = [("/p/a-b_c.html?x=1#y",), ("item",), ("//cdn.example/z",), ("http://plain.example/",), ("https://o.example/Q%C3%A9",)]
    absolute = urls.canonical(urls.resolve(F.lit(base), F.col("v")))
    assert run(spark, "v string", rows, absolute) == [
        "https://shop.example/p/a-b_c.html", "https://shop.example/en/item", "https://cdn.example/z", None, "https://o.example/Q%C3%A9"]
    cases = [("  Learn more  ", "https://x.example/p/a-b_c.html", -1), ("Great Board", "https://x.example/p", -1), ("all", "https://x.example/en/rtx%204070/specs", 1), ("", "https://x.example/", -1)]
    found = run(spark, "t string, u string, s int", cases, urls.link_label(F.col("t"), F.col("u"), F.col("s")))
    assert found == ["a b c", "Great Board", "rtx 4070", ""]


def test_inference(spark):
    assert run(spark, "k string", [("X870 / B850",), ("Z390",), ("LGA 4677",), ("rien",)], infer.infer_socket(F.col("k"), F.lit(""))) == ["AM5", "LGA1151 v2", "LGA 4677", "À vérifier"]
    assert run(spark, "m string", [("ASUS A (x, y), B, Intel, C1, Prime",)], infer.split_models(F.col("m"))) == [["ASUS A (x, y)", "Prime"]]
    assert run(spark, "r string", [("Ryzen 5 / Ryzen 7",), ("AMD Ryzen 5",)], infer.compact_name(F.lit("AMD"), F.col("r"))) == ["AMD Ryzen 5 et variantes", "AMD Ryzen 5"]
    assert run(spark, "d string", [("GeForce RTX",), ("NVMe SSD",), ("Wi-Fi 6",), ("Host bridge",)], infer.device_category(F.col("d"))) == ["gpu", "storage", "expansion", None]


def test_character_references(spark):
    import html

    rows = ["a &amp;lt; b", "129&times;136", "&reg;&nbsp;x", "&#39;&#x27;&#8217;", "plain", "R&D & co", "x &lt;b&gt;", "&#128512;", "fin &eacute;"]
    assert run(spark, "v string", [(r,) for r in rows], text.unescape_html(F.col("v"))) == [html.unescape(r) for r in rows]
    odd = run(spark, "v string", [("&unknown;",), ("&#xD800;",), (None,)], text.unescape_html(F.col("v")))
    assert odd == ["&unknown;", "\ufffd", None]


def test_relative_links_and_scheme_case(spark):
    from gearledger.functions.urls import canonical, resolve

    base = "https://a.b/x/y/z.html"
    cases = {"../p": "https://a.b/x/p", "../../../q": "https://a.b/q", "./r": "https://a.b/x/y/r", "/m/../n": "https://a.b/n", "..": "https://a.b/x/",
             "s/../t?u=..": "https://a.b/x/y/t?u=..", "plain": "https://a.b/x/y/plain", "https://c.d/e/../f": "https://c.d/e/../f"}
    df = spark.createDataFrame([(base, h) for h in cases], "base string, href string")
    assert {r.href: r.url for r in df.select("href", resolve(F.col("base"), F.col("href")).alias("url")).collect()} == cases
    df = spark.createDataFrame([("HTTPS://A.b/P",), ("http://a.b/p",)], "u string")
    assert [r[0] for r in df.select(canonical(F.col("u"))).collect()] == ["https://a.b/P", None]
