"""Document fingerprints: Merkle trees over sections and paragraphs.

A text is cut into sections (lines with their line end) and each section into paragraphs: up to five words with the
white space behind them, so short texts and long lines have branches too. A leaf is the hash of one paragraph, a section
node the hash of its leaves, the root the SHA-256 of all section nodes and the length. Equal texts have equal trees, the
differing branches say where an edit lies. A fingerprint is the tree as text: the root, then each section's node with its leaves.

The next document in id order is found without a global window: ids are cut into ranges at approximate quantiles (at most
``MAX_RANGES``, so the bounds are small), each range is one window partition, and only the first row of every range is handed to
the range before it.

Defined results: a null text is an empty one, whose tree has no section. Rows with a null id come first. Rows of one id
follow each other in text order. With a single document the next one is itself; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearledger.llm.common import cut_lineage, text_or_empty

SECTION = r"[^\n]*+\n|[^\n]++"
#: Words are cut at 64 characters, so a text without white space has paragraphs as well.
PARAGRAPH = r"(?:[^\s]{1,64}+[^\S\n]*+){1,5}+\n*+|\s++"
MAX_RANGES = 65536


def leaves(text: Column) -> Column:
    """Paragraph hashes by section."""
    sections = F.regexp_extract_all(text, F.lit(SECTION), 0)
    return F.transform(sections, lambda s: F.transform(F.regexp_extract_all(s, F.lit(PARAGRAPH), 0), lambda p: F.xxhash64(p)))


def _hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def fingerprint(tree: Column) -> Column:
    """root:section(leaf,leaf,…)section(…) in hexadecimal; leaves are shown by half of their hash."""
    sections = F.transform(tree, lambda s: F.concat(
        _hex(F.xxhash64(s)), F.lit("("), F.array_join(F.transform(s, lambda p: F.substring(_hex(p), 1, 8)), ","), F.lit(")")))
    root = F.sha2(F.array_join(F.transform(tree, lambda s: F.array_join(F.transform(s, lambda p: F.hex(p)), ",")), ";"), 256)
    return F.concat(root, F.lit(":"), F.array_join(sections, ""))


def branches(print_: Column) -> Column:
    """The distinct leaves that a fingerprint shows."""
    shown = F.regexp_extract_all(print_, F.lit(r"[(,]([0-9a-f]{8})(?=[,)])"), 1)
    return F.array_distinct(shown)


def likeness(a: Column, b: Column, leaves_a: Column, leaves_b: Column) -> Column:
    """Share of common leaves, 2 * common / all, and 1 for equal roots."""
    both = F.size(leaves_a) + F.size(leaves_b)
    same = F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1)
    return F.when(same, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(leaves_a, leaves_b)) / both)


def changed_sections(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the sections of fingerprint ``b`` whose node does not occur in ``a``: where the edit lies."""
    nodes = lambda p: F.regexp_extract_all(p, F.lit(r"([0-9a-f]{16})\("), 1)
    marked = F.transform(nodes(b), lambda n, i: F.when(~F.array_contains(nodes(a), n), i))
    return F.filter(marked, lambda i: i.isNotNull())


def in_id_order(docs: DataFrame, range_rows: int = 1024) -> DataFrame:
    """Every document (doc_id, text) with the text of the next one in id order, the first one's after the last."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    ranges = min(MAX_RANGES, -(-ids.count() // range_rows)) or 1
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", shares, 10000 if ranges < 5000 else 2 * MAX_RANGES)).first()[0] or [])) if shares else []
    if bounds:
        listed, steps = F.array(*[F.lit(b) for b in bounds]), F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
        # Binary search: how many bounds the id reaches.
        found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            F.coalesce(F.get(listed, at + step - 1) <= F.col("doc_id"), F.lit(False)), at + step).otherwise(at))
        texts, ids = texts.withColumn("range", found), ids.withColumn("range", found)
    else:
        texts, ids = texts.withColumn("range", F.lit(0)), ids.withColumn("range", F.lit(0))
    # One row per range: its first id, whose text goes to the range before (the last range gets the very first).
    heads = ids.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first"))
    before = F.lag("range").over(Window.orderBy("range"))
    heads = heads.select(F.col("first.doc_id").alias("doc_id"), F.coalesce(before, F.max("range").over(Window.partitionBy())).alias("to_range"))
    firsts = texts.join(F.broadcast(heads), texts["doc_id"].eqNullSafe(heads["doc_id"])).groupBy("to_range").agg(F.min("text").alias("first_text"))
    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    led = texts.withColumns({"next_text": F.lead("text").over(order), "is_last": F.lead(F.lit(1)).over(order).isNull()})
    key = F.when(F.col("is_last"), F.col("range"))
    led = led.join(F.broadcast(firsts), key == firsts["to_range"], "left")
    return led.select("doc_id", "text", F.coalesce("next_text", "first_text").alias("next_text"))


def fingerprints(docs: DataFrame, edit_divisor: int = 4) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and the likeness to these and to the next document's."""
    pairs = in_id_order(docs)
    n = F.length("text")
    cut = F.floor(n / edit_divisor).cast("int")
    pairs = pairs.withColumns({"n_chars": n.cast("bigint"), "edited": F.concat(
        F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))})
    made = pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(leaves(F.col("text"))).alias("fingerprint"),
        fingerprint(leaves(F.col("edited"))).alias("edited_fingerprint"), fingerprint(leaves(F.col("next_text"))).alias("next_fingerprint"),
    )
    made = made.withColumns({"own_leaves": branches(F.col("fingerprint")), "edited_leaves": branches(F.col("edited_fingerprint")), "next_leaves": branches(F.col("next_fingerprint"))})
    return made.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), F.col("own_leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), F.col("own_leaves"), F.col("next_leaves")).alias("near_next"),
        changed_sections(F.col("fingerprint"), F.col("edited_fingerprint")).alias("changed_sections"),
    )
