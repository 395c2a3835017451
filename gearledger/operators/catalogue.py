"""Catalogue queries: filtered, ranked and paginated lists, lookups, browsing, facets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearledger.functions.scores import value_score
from gearledger.functions.specs import display, flat_text
from gearledger.functions.text import fold_text, normalize_identifier, plain
from gearledger.model.dimensions import CATALOGUE_TO_PRODUCT

SORTS = ("relevance", "name", "newest", "completeness")


def _fold_literal(text: str) -> str:
    import re
    import unicodedata

    kept = "".join(c for c in unicodedata.normalize("NFKD", text) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub(r"[^a-z0-9]+", " ", kept.lower()).strip()


def query_groups(q: str | None) -> list[list[str]]:
    """Folded query words: alternatives (split at the word ``or``) of words that must all occur."""
    groups: list[list[str]] = [[]]
    for word in _fold_literal(q or "").split():
        if word == "or":
            groups.append([])
        else:
            groups[-1].append(word)
    return [g for g in groups if g]


def match_tokens(document: Column, q: str) -> Column:
    """Whole-word match of a folded document: every word of at least one alternative."""
    words = F.split(document, " ")
    options = [F.size(F.array_except(F.array(*[F.lit(w) for w in g]), words)) == 0 for g in query_groups(q)]
    return reduce(lambda a, b: a | b, options, F.lit(False))


def matches(document: Column, mpn: Column, q: str) -> Column:
    """Words, substring or exact normalised part number."""
    folded = _fold_literal(q)
    return (
        match_tokens(document, q) | F.contains(document, F.lit(folded))
        | (normalize_identifier(mpn) == normalize_identifier(F.lit(q)))
    )


def relevance(document: Column, q: str) -> Column:
    """Sum over query words of ``1 - 1/(1+tf)``; only the order it gives is used."""
    words = F.split(document, " ")
    terms = dict.fromkeys(w for g in query_groups(q) for w in g)

    def gain(term: str) -> Column:
        return 1 - F.lit(1.0) / (1 + F.size(F.filter(words, lambda x: x == term)))

    return sum((gain(t) for t in terms), start=F.lit(0.0))


def _predicates(q, category, brand, socket, capacity) -> list[Column]:
    """Absent parameters add no predicate; all of them end up in one filter."""
    found = []
    if q and _fold_literal(q):
        found.append(matches(F.col("search_document"), F.col("mpn"), q))
    if category and category not in ("all", "expansion"):
        found.append(F.col("category") == category)
    if brand:
        found.append(F.lower("brand") == brand.lower())
    if socket:
        found.append(F.lower(F.coalesce(flat_text(F.col("specs")["socket"]), F.lit(""))) == socket.lower())
    if capacity is not None:
        figure = F.nullif(flat_text(F.col("specs")["capacity"]), F.lit("")).try_cast("double")
        found.append(figure == float(capacity))
    return found


def _order(sort: str, q: str | None) -> list[Column]:
    tie = [F.asc("name"), F.asc("component_id")]
    if sort == "name":
        return tie
    if sort == "newest":
        return [F.desc_nulls_last("release_date"), *tie]
    if sort == "relevance" and q and _fold_literal(q):
        return [F.desc("rank"), F.desc("completeness"), F.asc("component_id")]
    return [F.desc("completeness"), *tie]


def list_components(
    components: DataFrame, q: str | None = None, category: str | None = None, brand: str | None = None,
    socket: str | None = None, capacity: int | None = None, sort: str = "relevance", page: int = 1, limit: int = 24,
) -> DataFrame:
    """One page of the catalogue with the total number of matches on every row."""
    if sort not in SORTS or not 1 <= limit <= 100 or page < 1:
        raise ValueError("sort, limit or page out of range")
    kept = reduce(lambda df, p: df.filter(p), _predicates(q, category, brand, socket, capacity), components)
    rank = relevance(F.col("search_document"), q) if q and _fold_literal(q) else F.lit(0.0)
    shown = [c for c in components.columns if c not in ("search_document", "raw")]
    ranked = kept.select(*shown, rank.alias("rank"))
    order, offset = _order(sort, q), (page - 1) * limit
    # A page is a top-k at any depth; for far pages of huge catalogues ``list_after`` needs no rows before the page.
    rows = ranked.orderBy(*order).offset(offset).limit(limit)
    total = kept.select(F.count("*").alias("n")).scalar()
    return rows.withColumn("total_count", total)


def list_after(components: DataFrame, after: tuple[int, str, str] | None, limit: int = 24, **filters) -> DataFrame:
    """Keyset page of the completeness order: rows after the last (completeness, name, id) that was shown."""
    wanted = {k: filters.get(k) for k in ("q", "category", "brand", "socket", "capacity")}
    kept = reduce(lambda df, p: df.filter(p), _predicates(**wanted), components)
    if after is not None:
        score, name, key = after
        kept = kept.filter(
            (F.col("completeness") < score)
            | ((F.col("completeness") == score) & ((F.col("name") > name) | ((F.col("name") == name) & (F.col("component_id") > key))))
        )
    return kept.orderBy(*_order("completeness", None)).limit(limit)


def search_products(products: DataFrame, q: str = "", category: str | None = None, socket: str | None = None) -> DataFrame:
    """Accent- and case-blind substring search over names and all specification values."""
    kept = products
    if category and category != "all":
        kept = kept.filter(F.col("category") == category)
    if socket:
        kept = kept.filter(plain(flat_text(F.col("specs")["Socket"])) == plain(F.lit(socket)))
    if q.strip():
        values = F.array_join(F.transform(F.map_values("specs"), flat_text), " ")
        text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("name", "reference", "brand", "series")], values)
        kept = kept.filter(F.contains(plain(text), plain(F.lit(q.strip()))))
    return kept


def lookup(components: DataFrame, kind: str, value: str) -> DataFrame:
    """Component by id or slug."""
    column = {"id": "component_id", "slug": "slug"}[kind]
    return components.filter(F.col(column) == value)


def lookup_mpn(components: DataFrame, identifiers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Components of each wanted part number, own or recorded identifier, with an ambiguity flag.

    ``wanted`` has one column ``mpn``. Two equi-joins and a union stand for the "own or recorded" condition.
    """
    keys = wanted.select(normalize_identifier(F.col("mpn")).alias("code")).filter(F.col("code") != "").distinct()
    own = components.select(normalize_identifier(F.col("mpn")).alias("code"), "component_id")
    recorded = identifiers.filter(F.col("type") == "mpn").select(F.col("value").alias("code"), "component_id")
    hits = own.unionByName(recorded).join(keys, "code", "left_semi").distinct()
    ambiguous = hits.groupBy("code").agg((F.min("component_id") != F.max("component_id")).alias("ambiguous"))
    return hits.join(ambiguous, "code")


def lookup_products(ids: DataFrame, products: DataFrame, fallback: DataFrame) -> DataFrame:
    """Product rows by id from the main table, else from the fallback table."""
    extra = fallback.join(products.select("product_id"), "product_id", "left_anti")
    return ids.join(products.unionByName(extra, allowMissingColumns=True), "product_id", "left")


def browse(
    products: DataFrame, brand: str | None = None, only_priced: bool = False, sort: str = "performance",
    page: int = 1, page_size: int = 24,
) -> DataFrame:
    """One page of the product browser, page clamped to the last one."""
    used, new = F.col("used_price"), F.col("new_price")
    kept = products
    if brand:
        kept = kept.filter(F.col("brand") == brand)
    if only_priced:
        kept = priced(kept)
    price = F.coalesce(used, new)
    keys = {
        "price-asc": price.asc_nulls_last(),
        "price-desc": price.desc_nulls_last(),
        "value": value_score(F.col("performance"), used, new).desc_nulls_last(),
    }
    order = [keys.get(sort, F.col("performance").desc_nulls_last()), F.asc("product_id")]
    # The page count is a single figure needed to clamp the page before it is cut.
    pages = max(1, -(-kept.count() // page_size))
    offset = (min(page, pages) - 1) * page_size
    return kept.orderBy(*order).offset(offset).limit(page_size)


def priced(products: DataFrame) -> DataFrame:
    return products.filter(F.col("new_price").isNotNull() | F.col("used_price").isNotNull())


def to_products(components: DataFrame) -> DataFrame:
    """Catalogue components seen as products: nine categories, confidence band, year, no prices."""
    from gearledger.model import literal_map

    c = F.col
    return components.select(
        c("component_id").alias("product_id"),
        F.coalesce(literal_map(CATALOGUE_TO_PRODUCT)[c("category")], F.lit("expansion")).alias("category"),
        "brand", "name",
        F.coalesce(c("mpn"), F.get("part_numbers", 0), F.lit("À vérifier")).alias("reference"),
        F.coalesce("series", "model", F.lit("")).alias("series"),
        F.year("release_date").alias("year"),
        F.when(c("confidence") >= 80, "Bonne").when(c("confidence") >= 60, "Moyenne").otherwise("Faible").alias("confidence"),
        F.lit("Documentaire").alias("status"), F.coalesce("description", F.lit("")).alias("notes"),
        F.coalesce("short_description", F.concat(F.lit("Référence "), c("primary_source"), F.lit(", complétude "), c("completeness"), F.lit(" %."))).alias("usage"),
        "specs",
    )


def facets(df: DataFrame) -> DataFrame:
    """Rows and sorted brands per category; brands are made distinct before they are gathered."""
    pairs = df.groupBy("category", "brand").agg(F.count("*").alias("n"))
    return pairs.groupBy("category").agg(
        F.sum("n").alias("products"), F.array_sort(F.collect_list("brand")).alias("brands")
    )


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, ties in value order."""
    return count_by(df, column).orderBy(F.desc("count"), F.asc(column)).limit(n)


def headline_specs(products: DataFrame, headline: dict[str, Sequence[str]]) -> DataFrame:
    """The few fields shown on a card: (product_id, position, key, shown).

    Categories without a list of their own show their first three fields in name order.
    """
    fixed = F.create_map(*[x for k, keys in headline.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in keys]))])
    keys = F.coalesce(fixed[F.col("category")], F.slice(F.array_sort(F.map_keys("specs")), 1, 3))
    present = F.filter(keys, lambda k: F.map_contains_key("specs", k))
    return products.select("product_id", "specs", F.posexplode(present).alias("position", "key")).select(
        "product_id", "position", "key", display(F.element_at("specs", F.col("key"))).alias("shown")
    )


def grouped_specs(products: DataFrame, sections: dict, other: str) -> DataFrame:
    """All fields of a sheet by section: (product_id, section_no, section, position, key, shown)."""
    entries = [
        x for category, groups in sections.items() for g, (title, keys) in enumerate(groups) for p, key in enumerate(keys)
        for x in (F.lit(f"{category}|{key}"), F.struct(F.lit(g).alias("g"), F.lit(title).alias("t"), F.lit(p).alias("p")))
    ]
    place = F.create_map(*entries)
    rows = products.select("product_id", "category", F.explode("specs").alias("key", "spec"))
    rows = rows.withColumn("at", place[F.concat_ws("|", "category", "key")])
    return rows.select(
        "product_id", F.coalesce("at.g", F.lit(99)).alias("section_no"), F.coalesce("at.t", F.lit(other)).alias("section"),
        F.coalesce("at.p", F.lit(0)).alias("position"), "key", display(F.col("spec")).alias("shown"),
    )
