"""Reading stored pages with regular expressions: tags, attributes, links, and what cells and JSON-LD objects say.

Elements that can be nested (tables, lists, labelled elements, JSON objects) are told apart in ``operators.markup``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gearledger.functions.text import clean_cell, clean_markup, let, squeeze, unescape_html

ROW = "struct<field:string,value:string,method:string>"
_HIDDEN = "(?is)<!--.*?-->|<(script|style|noscript|template|svg)\\b[^>]*>.*?</\\1\\s*>"
LD_SCRIPT = "(?is)<script\\b[^>]*ld\\+json[^>]*>(.*?)</script\\s*>"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def visible(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(html, _HIDDEN, "")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one tag, null when it is absent or empty."""
    pattern = f"(?is)[\\s\"']{name}\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))"
    found = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.nullif(unescape_html(found), F.lit(""))


def meta_map(html: Column) -> Column:
    """Lower-case property or name of every meta tag with its content; the last one of a name counts."""
    def entry(tag: Column) -> Column:
        key = F.coalesce(attribute(tag, "property"), attribute(tag, "name"), attribute(tag, "itemprop"))
        return F.struct(F.lower(key).alias("key"), attribute(tag, "content").alias("value"))

    entries = F.transform(_all(visible(html), "(?is)<meta\\b[^>]*>"), entry)
    kept = F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull())

    def last_of_each(backwards: Column) -> Column:
        # Later entries win: each key is looked up from the end instead of relying on duplicate map keys.
        return let(F.transform(backwards, lambda x: x["key"]), lambda keys: F.map_from_entries(
            F.filter(backwards, lambda e, i: F.array_position(keys, e["key"]) == i + 1)))

    return let(F.reverse(kept), last_of_each)


def title(html: Column) -> Column:
    return clean_markup(F.array_join(_all(html, "(?is)<title\\b[^>]*>(.*?)</title\\s*>", 1), " "))


def first_heading(html: Column) -> Column:
    return clean_markup(F.regexp_extract(visible(html), "(?is)<h1\\b[^>]*>(.*?)</h1\\s*>", 1))


def canonical_href(html: Column) -> Column:
    """href of the last canonical link."""
    tags = F.filter(_all(visible(html), "(?is)<link\\b[^>]*>"), lambda t: F.contains(F.lower(attribute(t, "rel")), F.lit("canonical")))
    return F.try_element_at(F.filter(F.transform(tags, lambda t: attribute(t, "href")), lambda h: h.isNotNull()), F.lit(-1))


def links(html: Column) -> Column:
    """``array<struct<position,href,text>>`` of the links of a page in document order.

    The text is that of the headings inside the link, else all its text with picture descriptions.
    """
    def entry(anchor: Column, i: Column) -> Column:
        opening = F.regexp_extract(anchor, "(?is)^<a\\b[^>]*>", 0)
        inner = F.regexp_replace(anchor, "(?is)^<a\\b[^>]*>|</a\\s*>$", "")
        heads = clean_markup(F.array_join(_all(inner, "(?is)<h([1-6])\\b[^>]*>(.*?)</h\\1\\s*>", 2), " "))
        pictured = F.regexp_replace(inner, "(?is)<img\\b[^>]*?\\balt\\s*=\\s*\"([^\"]*)\"[^>]*>", " $1 ")
        text = F.coalesce(F.when(inner.rlike("(?i)<h[1-6]\\b"), let(heads, lambda h: F.nullif(h, F.lit("")))), clean_markup(pictured))
        return F.struct(i.alias("position"), attribute(opening, "href").alias("href"), text.alias("text"))

    anchors = _all(visible(html), "(?is)<a\\b[^>]*>.*?</a\\s*>")
    return F.filter(F.transform(anchors, entry), lambda e: e["href"].isNotNull())


def cell_text(text: Column) -> Column:
    """Text of a cell without the tags left in it, character references resolved."""
    return clean_cell(unescape_html(F.regexp_replace(text, "<[/A-Za-z!][^>]*>", "")))


def _row(field: Column, value: Column, method: str) -> Column:
    return F.struct(field.alias("field"), value.alias("value"), F.lit(method).alias("method"))


def _no_rows() -> Column:
    return F.array().cast(f"array<{ROW}>")


def _zip(left: Column, right: Column, method: str) -> Column:
    return F.zip_with(left, right, lambda a, b: _row(a, b, method))


def table_pairs(lines: Column) -> Column:
    """Label/value rows of one table, given its lines (cells, heads, head). A table of several references is never reduced to one of them."""
    is_heading = lambda r: r["head"] | ((r["heads"] == F.size(r["cells"])) & (F.size(r["cells"]) >= 2))

    def read(parts: Column) -> Column:
        headings, data = parts["headings"], parts["data"]
        columns = F.coalesce(F.array_max(F.transform(headings, lambda r: F.size(r["cells"]))), F.lit(0))
        pairs = F.transform(
            F.filter(data, lambda r: F.size(r["cells"]) == 2),
            lambda r: _row(F.get(r["cells"], 0), F.get(r["cells"], 1), "spec-table"),
        )
        # Names and values are paired up to the shorter side.
        names, values = F.get(headings, 0)["cells"], F.get(data, 0)["cells"]
        width = F.least(F.size(names), F.size(values))
        single = F.when(
            (F.size(data) == 1) & (F.size(values) == columns),
            _zip(F.slice(names, F.lit(1), width), F.slice(values, F.lit(1), width), "spec-table"),
        )
        return F.when(columns < 3, pairs).otherwise(F.coalesce(single, _no_rows()))

    filled = F.filter(lines, lambda r: F.exists(r["cells"], lambda c: c != ""))
    split = let(filled, lambda f: F.struct(
        F.filter(f, is_heading).alias("headings"), F.filter(f, lambda r: ~is_heading(r)).alias("data")))
    return let(split, read)


def list_pairs(items: Column) -> Column:
    """Pairs of a definition list, given its items (kind, text); lists without any figure are navigation."""
    def read(x: Column) -> Column:
        pairs = F.transform(x, lambda item, i: F.struct(
            item["kind"].alias("kind"), F.when(F.get(x, i - 1)["kind"] == "dt", F.get(x, i - 1)["text"]).alias("term"), item["text"].alias("text")))
        kept = F.filter(pairs, lambda p: (p["kind"] == "dd") & F.coalesce(p["term"] != "", F.lit(False)))
        rows = F.transform(kept, lambda p: _row(p["term"], p["text"], "definition-list"))
        return let(rows, lambda r: F.when(F.exists(r, lambda y: y["value"].rlike("\\d")), r).otherwise(_no_rows()))

    return let(items, read)


def label_pairs(items: Column) -> Column:
    """``array<struct<end, row>>``: each value element (end, kind, text) with the label element right before it."""
    def read(x: Column) -> Column:
        paired = F.transform(x, lambda item, i: F.struct(
            item["end"].alias("end"), F.when((item["kind"] == "value") & (F.get(x, i - 1)["kind"] == "label"), _row(F.get(x, i - 1)["text"], item["text"], "spec-list")).alias("row")))
        return F.filter(paired, lambda p: p["row"].isNotNull())

    return let(items, read)


def acceptable(field: Column, value: Column, method: Column) -> Column:
    """Filled, a name with a letter, and no value that only repeats its name (JSON-LD names are taken as they are)."""
    return (field != "") & (value != "") & ((method == "json-ld") | ((field != value) & field.rlike("[a-zA-Z]")))


def _printed(v: Column) -> Column:
    """A JSON scalar the way it is printed; objects give their name or value, lists a comma list."""
    inner = F.coalesce(F.nullif(F.try_variant_get(v, "$.name", "string"), F.lit("")), F.try_variant_get(v, "$.value", "string"))
    items = F.filter(F.try_variant_get(v, "$", "array<string>"), lambda x: x.isNotNull() & (x != ""))
    kind = F.schema_of_variant(v)
    return (
        F.when(kind.startswith("OBJECT"), inner).when(kind.startswith("ARRAY"), F.array_join(items, ", "))
        .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string"))).otherwise(F.try_variant_get(v, "$", "string"))
    )


def node_properties(node: Column) -> Column:
    """``array<variant>`` of the additional properties of one JSON-LD object."""
    raw = F.try_variant_get(node, "$.additionalProperty", "variant")
    kind = F.schema_of_variant(raw)
    listed = F.when(kind.startswith("OBJECT"), F.array(raw)).when(kind.startswith("ARRAY"), F.try_variant_get(raw, "$", "array<variant>"))
    return F.filter(F.coalesce(listed, F.array().cast("array<variant>")), lambda p: F.schema_of_variant(p).startswith("OBJECT"))


def property_name(prop: Column) -> Column:
    return F.coalesce(
        F.nullif(_printed(F.try_variant_get(prop, "$.name", "variant")), F.lit("")),
        _printed(F.try_variant_get(prop, "$.propertyID", "variant")), F.lit(""),
    )


def property_value(prop: Column) -> Column:
    return F.coalesce(_printed(F.try_variant_get(prop, "$.value", "variant")), F.lit(""))


def property_rows(node: Column) -> Column:
    """Label/value rows of the additional properties of one JSON-LD object."""
    return F.transform(node_properties(node), lambda p: _row(clean_cell(property_name(p)), clean_cell(property_value(p)), "json-ld"))


def prose_rows(html: Column) -> Column:
    """The page description as one row."""
    def describe(metas: Column) -> Column:
        return F.coalesce(*[F.nullif(clean_cell(metas[k]), F.lit("")) for k in ("og:description", "description")])

    return let(let(meta_map(html), describe), lambda text: F.when(
        text.isNotNull(), F.array(_row(F.lit("og:description"), text, "meta"))).otherwise(_no_rows()))


def first_text(value: Column) -> Column:
    """Clean text of a JSON value: an object gives its name or value, a list its first filled item."""
    kind = F.schema_of_variant(value)
    items = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(_printed(x) != "", F.lit(False)))
    shown = F.when(kind.startswith("ARRAY"), _printed(F.get(items, 0))).otherwise(_printed(value))
    return F.coalesce(squeeze(unescape_html(F.regexp_replace(shown, "<[^>]+>", " "))), F.lit(""))
