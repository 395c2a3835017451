"""Structure of stored pages: elements that end at their own closing tag and JSON objects at any depth, as rows.

A page becomes rows of tags, each with the text behind it. Running depths over these rows say which tags belong together, so tables in
tables, lists in values and elements nested in others of their name are told apart, however deep they go. Everything is
keyed by page: one shuffle deals the pages out, their tags, the windows and groups behind it stay where they are. Tags with their
windows take a hundred times the memory of their page, so a task gets ``SHARE`` characters of pages, however many pages there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearledger.functions.html import LD_SCRIPT, cell_text, label_pairs, list_pairs, table_pairs, visible
from gearledger.session import tasks_for

_KEPT = "table|thead|tbody|tfoot|tr|td|th|dl|dt|dd|br|li"
_CLASS = "(?i)class\\s*=\\s*[\"']?(?:[^\"'>]*[\\s_-])?(?:label|value)(?:[\\s_-]|[\"'>])"
_NAME = "^</?([A-Za-z][A-Za-z0-9]*)"
#: What one bracket of a JSON text ends: the text before it, in which brackets inside strings don't count.
_BRACKET = "(?:\"(?:[^\"\\\\]|\\\\.)*+\"|[^\"{}\\[\\]]++)*+[{}\\[\\]]"
_LAST = 1 << 62
#: Characters of pages, or of one page if it has more, that one task opens up.
SHARE = 4 << 20


def _depth(opens: Column, closes: Column, line) -> Column:
    """How many are open after each row; a closing tag without an opening one counts for nothing."""
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    total = F.sum(step).over(line)
    return step, total


def _levels(rows: DataFrame, name: str, opens: Column, closes: Column, *by: str) -> DataFrame:
    """Adds ``name``: the depth a row lies at; an opening and its closing row have the depth they enclose."""
    line = Window.partitionBy(*by).orderBy("at")
    step, total = _depth(opens, closes, line)
    rows = rows.withColumn("_total", total)
    # The total never falls below zero if what was closed too often is given back.
    rows = rows.withColumn("_depth", F.col("_total") - F.least(F.lit(0), F.min("_total").over(line)))
    return rows.withColumn(name, F.col("_depth") + F.when(closes, 1).otherwise(0)).drop("_total", "_depth")


def page_tasks(pages: DataFrame) -> int:
    """How many tasks pages have to be dealt over."""
    return tasks_for(pages, SHARE, F.length("html"))


def page_tags(pages: DataFrame, key: str, tasks: int) -> DataFrame:
    """(key, at, name, closing, kind, tail) of the tags that can matter, in document order; kind is that of an opened cell: td, th, dt, dd, label, value.

    Pages without a table, list or labelled element give no row. Where no element is labelled, only tags of tables and lists are
    kept, the text between the others goes to the tag before.
    """
    shown = pages.select(F.col(key).alias("page"), visible(F.col("html")).alias("html"))
    shown = shown.withColumn("labelled", F.col("html").rlike(_CLASS))
    bare = F.regexp_replace("html", f"(?i)</?(?!(?:{_KEPT})\\b)[a-z!][^>]*>", "")
    # Pages without anything of interest give no tags at all; asked here and not by a filter, which the optimizer would carry through every window below.
    text = F.when(F.col("labelled"), F.col("html")).when(F.col("html").rlike("(?i)<(?:table|dl)\\b"), bare)
    dealt = shown.select("page", text.alias("text")).repartition(tasks, "page")
    parts = dealt.select("page", F.posexplode(F.regexp_extract_all("text", F.lit("<[/A-Za-z!][^>]*>(?:[^<]|<(?![/A-Za-z!]))*+"), F.lit(0))).alias("at", "part"))
    tag = F.regexp_extract("part", "^<[^>]*>", 0)
    tags = parts.select(
        "page", "at", F.lower(F.regexp_extract("part", _NAME, 1)).alias("name"), F.startswith("part", F.lit("</")).alias("closing"),
        F.lower(F.regexp_extract(tag, "(?i)[\\s\"']class\\s*=\\s*(\"[^\"]*|'[^']*|[^\\s\"'>]+)", 1)).alias("class"),
        F.substring(F.col("part"), F.length(tag) + 1, F.length("part")).alias("tail"))
    named = lambda word: F.col("class").rlike(f"(^[\"']?|[\\s_-]){word}([\\s_-]|$)")
    kind = F.when(F.col("name").isin("td", "th", "dt", "dd"), F.col("name")).when(
        F.col("name").isin("table", "thead", "dl", "tr", "br", "meta"), None).when(named("label"), "label").when(named("value"), "value")
    return tags.withColumn("kind", F.when(~F.col("closing"), kind)).drop("class")


def page_cells(tags: DataFrame) -> DataFrame:
    """One row per cell that lies in no other cell: page, at, end, kind, text, and the table, row and list it lies in.

    A table cell ends at its closing tag or where its own table goes on, a list item likewise, a labelled element at the closing tag
    of its depth (one that never closes is none).
    """
    opened, closed = ~F.col("closing"), F.col("closing")
    is_ = lambda *names: F.col("name").isin(*names)
    rows = _levels(tags, "tables", is_("table") & opened, is_("table") & closed, "page")
    rows = _levels(rows, "lists", is_("dl") & opened, is_("dl") & closed, "page")
    rows = _levels(rows, "same", opened, closed, "page", "name")
    in_table = Window.partitionBy("page", "tables").orderBy("at")
    in_list = Window.partitionBy("page", "lists").orderBy("at")
    rows = rows.withColumns({
        "table": F.max(F.when(is_("table") & opened, F.col("at"))).over(in_table),
        "list": F.max(F.when(is_("dl") & opened, F.col("at"))).over(in_list),
    })
    in_table, in_list = Window.partitionBy("page", "tables", "table").orderBy("at"), Window.partitionBy("page", "lists", "list").orderBy("at")
    later = lambda line: line.rowsBetween(1, Window.unboundedFollowing)
    next_of = lambda names, line: F.min(F.when(is_(*names), F.col("at"))).over(later(line))
    rows = rows.withColumns({
        "row": F.max(F.when(is_("tr") & opened, F.col("at"))).over(in_table),
        "head": F.last(F.when(is_("thead", "tbody", "tfoot"), is_("thead") & opened), ignorenulls=True).over(in_table),
        "table_end": F.coalesce(F.max(F.when(is_("table") & closed, F.col("at"))).over(Window.partitionBy("page", "tables", "table")), F.lit(_LAST)),
        "list_end": F.coalesce(F.max(F.when(is_("dl") & closed, F.col("at"))).over(Window.partitionBy("page", "lists", "list")), F.lit(_LAST)),
        "cell_end": F.lead("at").over(Window.partitionBy("page", "tables", "table", is_("table", "thead", "tbody", "tfoot", "tr", "td", "th")).orderBy("at")),
        "item_end": F.lead("at").over(Window.partitionBy("page", "lists", "list", is_("dl", "dt", "dd")).orderBy("at")),
        "own_end": F.lead("at").over(Window.partitionBy("page", "name", "same").orderBy("at")),
    })
    kind = F.col("kind")
    end = (
        F.when(kind.isin("td", "th") & (F.col("tables") > 0), F.coalesce("cell_end", F.lit(_LAST)))
        .when(kind.isin("dt", "dd") & (F.col("lists") > 0), F.coalesce("item_end", F.lit(_LAST)))
        .when(kind.isin("label", "value"), F.col("own_end"))
    )
    rows = rows.withColumn("end", end)
    line = Window.partitionBy("page").orderBy("at")
    before = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("outer", F.col("end").isNotNull() & (F.coalesce(before, F.lit(0)) <= F.col("at")))
    # Outer cells don't overlap, so the last one that began is the one a tag may lie in.
    rows = rows.withColumn("cell", F.max(F.when(F.col("outer"), F.struct("at", "end"))).over(line))
    inside = rows.filter(F.col("at") < F.col("cell.end")).withColumn(
        "piece", F.concat(F.when(is_("br", "li") & opened, ", ").otherwise(""), F.col("tail")))
    own = lambda c: F.max(F.when(F.col("outer"), F.col(c))).alias(c)
    cells = inside.groupBy("page", F.col("cell.at").alias("at"), F.col("cell.end").alias("end")).agg(
        F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"), *[own(c) for c in ("kind", "table", "table_end", "row", "list", "list_end", "head")])
    return cells.withColumn("text", cell_text(F.array_join(F.transform("pieces", lambda p: p["piece"]), ""))).drop("pieces")


def layout_rows(pages: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """(key, close, nth, field, value, method) of the label/value rows of tables, definition lists and labelled elements.

    ``close`` is the place where the table, list or value ends, ``nth`` the order within it.
    """
    cells = page_cells(page_tags(pages, key, tasks or page_tasks(pages)))
    kind = F.col("kind")
    form = F.when(kind.isin("td", "th") & F.col("row").isNotNull(), "table").when(kind.isin("dt", "dd") & F.col("list").isNotNull(), "list").when(kind.isin("label", "value"), "pairs")
    of = lambda table, lists, pairs: F.when(F.col("form") == "table", table).when(F.col("form") == "list", lists).otherwise(pairs)
    none = F.lit(0)
    placed = cells.withColumn("form", form).withColumns({
        "block": of(F.col("table"), F.col("list"), none), "close": of(F.col("table_end"), F.col("list_end"), none), "line": of(F.col("row"), none, none)})
    # All three kinds of block go through the same two groupings: cells to lines, lines to blocks. A list and the labelled elements of a page are one line.
    listed = lambda *columns: F.array_sort(F.collect_list(F.struct(*columns)))
    lines = placed.groupBy("page", "form", "block", "close", "line").agg(
        listed("at", "end", "kind", "text").alias("items"), F.count_if(kind == "th").alias("heads"), F.coalesce(F.first("head"), F.lit(False)).alias("head"))
    blocks = lines.groupBy("page", "form", "block", "close").agg(listed("line", "items", "heads", "head").alias("lines"))
    texts = F.transform("lines", lambda r: F.struct(F.transform(r["items"], lambda c: c["text"]).alias("cells"), r["heads"].alias("heads"), r["head"].alias("head")))
    items = F.get("lines", F.lit(0))["items"]
    closed = lambda rows: F.transform(rows, lambda r: F.struct(F.col("close").cast("bigint").alias("end"), r.alias("row")))
    found = F.when(F.col("form") == "table", closed(table_pairs(texts))).when(F.col("form") == "list", closed(list_pairs(items))).when(
        F.col("form") == "pairs", F.transform(label_pairs(items), lambda p: F.struct(p["end"].cast("bigint").alias("end"), p["row"].alias("row"))))
    out = blocks.select("page", F.posexplode(found).alias("nth", "p"))
    return out.select(F.col("page").alias(key), F.col("p.end").alias("close"), "nth", "p.row.*")


def ld_objects(pages: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """(key, document, at, node) of every object of the JSON-LD documents of a page, at any depth; (document, at) is document order, node is JSON text.

    Only the places of brackets are rows; the text stays with its document until the objects are known. Documents that aren't JSON give none.
    """
    documents = pages.filter(F.col("html").rlike("(?i)ld\\+json")).select(
        F.col(key).alias("page"), F.posexplode(F.regexp_extract_all("html", F.lit(LD_SCRIPT), F.lit(1))).alias("document", "text"))
    documents = documents.filter(F.try_parse_json("text").isNotNull()).repartition(tasks or page_tasks(pages), "page", "document")
    parts = documents.select("page", "document", F.posexplode(F.transform(
        F.regexp_extract_all("text", F.lit(_BRACKET), F.lit(0)), lambda p: F.struct(F.length(p).alias("size"), F.right(p, F.lit(1)).alias("bracket")))).alias("at", "p"))
    rows = parts.select("page", "document", "at", "p.*")
    opens, closes = F.col("bracket").isin("{", "["), F.col("bracket").isin("}", "]")
    rows = rows.withColumn("place", F.sum("size").over(Window.partitionBy("page", "document").orderBy("at")))
    rows = _levels(rows, "depth", opens, closes, "page", "document")
    rows = rows.withColumn("end", F.lead("place").over(Window.partitionBy("page", "document", "depth").orderBy("at")))
    spans = rows.filter("bracket = '{'").groupBy("page", "document").agg(F.sort_array(F.collect_list(F.struct("place", "end"))).alias("spans"))
    found = documents.join(spans, ["page", "document"]).select("page", "document", "text", F.explode("spans").alias("s"))
    node = F.substring(F.col("text"), F.col("s.place").cast("int"), (F.col("s.end") - F.col("s.place") + 1).cast("int"))
    return found.select(F.col("page").alias(key), "document", F.col("s.place").alias("at"), node.alias("node"))
