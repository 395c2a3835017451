"""SimHash near-duplicates by pivot distance tables.

A fingerprint has 64 bits: the majority of the hash bits of a text's word shingles. Equal fingerprints collapse to one
row first, so copies never meet in pairs. Every distinct fingerprint carries a table row, its Hamming distances to many
reference fingerprints (rows of a 64 x 64 Hadamard matrix). Fingerprints that differ in at most ``distance`` bits differ by
at most that much in every coordinate, so a pair is discarded by its largest coordinate difference and only survivors
are verified. (For orthogonal references the squared differences of all 64 add up to 64 times the distance.)

Pairs are enumerated without a cross join: the bits are cut into ``distance + 2`` blocks; at least two blocks of a pair that
links are equal, so fingerprints meet on every choice of two equal blocks. A block pair that more than ``crowd`` fingerprints
share is refined by cutting the remaining bits in the same way; what still shares such a key differs in 16 bits at most.

Groups are connected components of the links, named by their smallest id. Defined results: a text without words, and a
null text, has fingerprint zero and is linked like any other; fewer words than a shingle make one shingle of the whole
sequence. Repeated rows fall into one group. Rows with a null id take part and join others; a group of such rows only has a null name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearledger.llm.common import cut_lineage
from gearledger.llm.components import components
from gearledger.session import Scratch

BITS = 64


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle of a text, repeats included; fewer words than a shingle make one."""
    import re

    import xxhash

    if not text:
        return np.zeros(0, dtype="<u8")
    # A-Z only; other letters keep their case.
    raw = text.encode("utf-8", "surrogatepass").lower()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return np.zeros(0, dtype="<u8")
    size = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[size - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=False)), dtype="<u8", count=len(ends))


def majority(hashes: np.ndarray, chunk: int = 1 << 16) -> int:
    """The fingerprint: bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), chunk):
        bits = np.unpackbits(hashes[at:at + chunk].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint as signed long) of every row of ``docs`` (doc_id, text)."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            made = np.array([majority(shingle_hashes(t, shingle)) for t in frame["text"]], dtype="<u8").view("<i8")
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fingerprint": made})

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.mapInPandas(hashed, "doc_id bigint, fingerprint bigint")


def references(count: int) -> list[int]:
    """Rows of the Hadamard matrix of order 64 as signed longs: bit j of row i is the parity of i & j."""
    rows = []
    for i in range(count):
        value = sum(((i & j).bit_count() & 1) << j for j in range(BITS))
        rows.append(value - (1 << 64) if value >> 63 else value)
    return rows


def table_row(fingerprint: Column, pivots: list[int]) -> list[Column]:
    return [F.bit_count(fingerprint.bitwiseXOR(F.lit(p))).cast("tinyint").alias(f"d{i}") for i, p in enumerate(pivots)]


def _blocks(bits: list[int], count: int) -> list[list[int]]:
    return [bits[len(bits) * i // count: len(bits) * (i + 1) // count] for i in range(count)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def links(distinct: DataFrame, scratch: Scratch, distance: int = 2, pivots: int = 64, crowd: int = 2048) -> DataFrame:
    """All pairs (a < b) of distinct fingerprints (fingerprint) that differ in at most ``distance`` bits."""
    refs = references(pivots)
    names = [f"d{i}" for i in range(pivots)]
    parts = _blocks(list(range(BITS)), distance + 2)
    choices = []
    for i, pair in enumerate(combinations(range(distance + 2), 2)):
        fixed = [b for k in pair for b in parts[k]]
        choices.append((i, fixed, [b for b in range(BITS) if b not in fixed]))

    def keys(masks: list[tuple[int, int]]) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits")) for i, m in masks])

    def keyed(frame: DataFrame, each: Column) -> DataFrame:
        return frame.select("fingerprint", F.explode(each).alias("k")).select("fingerprint", "k.choice", "k.bits")

    def met(rows: DataFrame) -> DataFrame:
        """Pairs of one key that the tables don't discard, verified."""
        side = rows.select("choice", "bits", "fingerprint", *table_row(F.col("fingerprint"), refs))
        a, b = side.alias("a"), side.alias("b")
        within = F.greatest(*[F.abs(F.col(f"a.{n}") - F.col(f"b.{n}")) for n in names]) <= distance
        verified = F.bit_count(F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))) <= distance
        on = (F.col("a.choice") == F.col("b.choice")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.fingerprint") < F.col("b.fingerprint"))
        return a.join(b, on & within & verified).select(F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b"))

    rows = keyed(distinct, keys([(i, _mask(fixed)) for i, fixed, _ in choices]))
    sizes = rows.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n"))
    shared = scratch.cut(rows.join(sizes.filter("n > 1"), ["choice", "bits"]))
    # One join for all keys, so the plan and its tasks, which the driver keeps, don't multiply with the choices.
    each = F.when(F.col("n") <= crowd, F.array(F.struct("choice", "bits")))
    for i, fixed, free in choices:
        # Within one key of this choice only the free bits can differ, so the same cut applies to them.
        finer = _blocks(free, distance + 2)
        each = each.when(
            F.col("choice") == i, keys([(100 * (i + 1) + j, _mask([*fixed, *(b for k in pair for b in finer[k])])) for j, pair in enumerate(combinations(range(distance + 2), 2))]))
    return met(keyed(shared, each))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, pivots: int = 64, crowd: int = 2048) -> DataFrame:
    """(doc_id, fingerprint as signed long, component_id) of every row: its group of near-duplicates by its smallest id."""
    hashed = cut_lineage(fingerprints(docs, shingle))
    with Scratch(docs.sparkSession) as scratch:
        distinct = scratch.cut(hashed.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc")))
        # Fingerprints are the nodes, so rows without an id link others too; a group is named last.
        groups = components(scratch.cut(links(distinct, scratch, distance, pivots, crowd)), scratch)
        grouped = distinct.join(groups, distinct["fingerprint"] == groups["node"], "left").withColumn("group", F.coalesce("component", "fingerprint"))
        grouped = scratch.cut(grouped.select("fingerprint", "first_doc", "group"))
        names = grouped.groupBy("group").agg(F.min("first_doc").alias("component_id"))
        named = scratch.keep(grouped.join(names, "group").select("fingerprint", "component_id"))
    return hashed.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_fingerprint(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


WORDS = 16


def parity(hashes: np.ndarray) -> np.ndarray:
    """64 * WORDS bits, each the parity of the number of hashes that fall on it."""
    bits = np.bincount((hashes >> np.uint64(54)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def among(rows: DataFrame, wanted: DataFrame, key: str, slots_each: int = 16, most_slots: int = 1 << 27) -> DataFrame:
    """``rows`` without most of those whose ``key`` (not null) is none of ``wanted``, found where they lie; all others stay.

    Tasks get a bit per slot of the key's hash, ``slots_each`` times the wanted rows, but ``most_slots`` (16 MB) at most. Beyond that more rows stay.
    """
    slots = max(1, min(most_slots, slots_each * wanted.count()))
    slot = F.pmod(F.xxhash64(key), F.lit(slots).cast("bigint"))
    asked = wanted.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("at")).repartition("bucket")
    bitmaps = asked.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bitmap"))
    # Eight slots a byte, the first one lowest.
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright(at, 3).cast("int") + 1, 1)), 16, 10).cast("int")
    held = rows.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bitmaps), "bucket")
    return held.filter(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).select(*rows.columns)


def near_copies(
    docs: DataFrame, scratch: Scratch, shingle: int = 5, similarity: float = 0.8, crowd: int = 2048, least_sample: int = 4096, sample_share: float = 1 / 16,
    most_common: int = 1 << 20, distance: int = 2,
) -> DataFrame:
    """(text_key, component) of every text of ``docs`` that has a near copy: groups of texts whose sets of word shingles are similar.

    Two texts are linked exactly if the Jaccard value of their distinct shingle hashes is ``similarity`` or more. Pairs come from their SimHash
    fingerprints first: those that differ in at most ``distance`` bits, by pivot tables (see ``links``), and texts of one fingerprint. Similar texts
    can differ in more bits than blocks can enumerate, so the rest comes from a prefix filter: all sets are put in one order, common shingles
    last, and two similar sets share one of their first ``size - ceil(similarity * size) + 1`` shingles. At the first shared one what is
    left of both sets must reach the overlap that their sizes ask for. Any order finds the same pairs; which shingles are common (the
    ``most_common`` most frequent at most) is counted in ``sample_share`` of the texts, so it sharpens as the corpus grows.

    A pair is then held against two short sketches. Each bit of a sketch is the parity of the shingles that fall on it, so the sketches differ in no
    more bits than the sets differ in shingles, and similar sets differ in few. Only for pairs that pass are whole sets made and compared.

    Groups don't need all of their pairs: what the fingerprints left in different components meets the two leaders of each of its shingles, the text
    whose shingles are shared most and the one with the least hash; then all pairs that these links leave apart are decided. A shingle that
    over ``crowd`` texts share is dealt over several tasks. Texts are named by their MD5; a null text is an empty one, and a text without words is in
    a group of its own. Tables belong to ``scratch``, the result reads them.
    """
    spark = docs.sparkSession
    texts = docs.select(F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), "text")
    steps = 1 << 30
    share = min(steps, max(int(sample_share * steps), -(-least_sample * steps // max(1, texts.count()))))
    some = texts.filter(F.pmod(F.xxhash64("text_key"), F.lit(steps)) < share)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            # Copies count once in a batch; over all batches they may count more, which only changes the order.
            sets = [np.unique(shingle_hashes(t, shingle)) for t in frame.drop_duplicates("text_key")["text"]]
            hashes, n = np.unique(np.concatenate([*sets, np.zeros(0, dtype="<u8")]), return_counts=True)
            yield pd.DataFrame({"hash": hashes.view("<i8"), "n": n.astype(np.int64)})

    often = some.mapInPandas(counted, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 3")
    often = often.orderBy(F.desc("n"), "hash").limit(most_common).toPandas()
    order = np.argsort(often["hash"].to_numpy(np.int64).view("<u8"))
    common = spark.sparkContext.broadcast((often["hash"].to_numpy(np.int64).view("<u8")[order], often["n"].to_numpy(np.int64)[order]))

    def first_ones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, times = common.value
        for frame in (batch.iloc[at:at + 1024] for batch in batches for at in range(0, len(batch), 1024)):
            out = []
            for key, text in zip(frame["text_key"], frame["text"], strict=True):
                every = shingle_hashes(text, shingle)
                hashes = np.unique(every)
                size = len(hashes)
                if not size:
                    continue
                sketch = parity(hashes)
                bits = np.uint64(majority(every)).astype(np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    hashes = hashes[np.argsort(np.where(known[at] == hashes, times[at], 0), kind="stable")]
                out.append((key, size, hashes[: size - int(np.ceil(similarity * size - 1e-9)) + 1].view("<i8"), sketch, bits))
            yield pd.DataFrame(out, columns=["text_key", "size", "first", "sketch", "fingerprint"])

    made = texts.mapInPandas(first_ones, "text_key string, size int, first array<bigint>, sketch array<bigint>, fingerprint bigint")
    # Copies have equal rows; one of each goes on. The number is written with its row, so it stays.
    single = made.groupBy("text_key").agg(*[F.first(c).alias(c) for c in ("size", "first", "sketch", "fingerprint")])
    single = scratch.cut(single.withColumn("node", F.monotonically_increasing_id()))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            sets = [np.unique(shingle_hashes(t, shingle)).view("<i8") for t in frame["text"]]
            yield pd.DataFrame({"node": frame["node"], "homes": frame["homes"], "shingles": sets})

    def reach(size_a: Column, rest_a: Column, size_b: Column, rest_b: Column) -> Column:
        """Can two sets still be similar if a shingle with so many from it on is the first that they share?"""
        return F.least(rest_a, rest_b) >= (size_a + size_b) * (similarity / (1 + similarity)) - 1e-6

    def with_ends(pairs: DataFrame, side: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(side.select(*[F.col(c).alias(end if c == "node" else f"{c}_{end}") for c in side.columns]), end)
        return pairs

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar."""
        short = single.select("node", "size", *[F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(WORDS)])
        apart = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(WORDS)), F.lit(0))
        near = with_ends(pairs, short).filter(apart <= (F.col("size_a") + F.col("size_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6)
        likely = scratch.cut(near.select("a", "b"))
        scratch.tidy()
        if likely.isEmpty():
            return likely
        # Of each pair one end goes to the other, the one that is in fewer pairs: a text that many are held against stays where it is.
        ends = likely.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("pairs"))
        ends = scratch.cut(ends.join(single.select("node", "text_key"), "node"))
        a, b = (F.struct(F.col(f"pairs_{end}").alias("pairs"), F.col(end).alias("node"), F.col(f"text_key_{end}").alias("text_key")) for end in ("a", "b"))
        met = with_ends(likely, ends).select(F.greatest(a, b).alias("home"), F.explode(F.array(a, b)).alias("end"))
        asked = scratch.cut(met.groupBy("end.node", "end.text_key").agg(F.collect_set("home.node").alias("homes")))
        # One row of each text that is asked for is moved, once; then sets go to their homes.
        one = among(texts, asked, "text_key").dropDuplicates(["text_key"]).join(asked, "text_key").select("node", "homes", "text")
        sets = scratch.cut(one.mapInPandas(hashed, "node bigint, homes array<bigint>, shingles array<bigint>"))
        scratch.tidy()
        own = sets.filter(F.array_contains("homes", F.col("node"))).select(F.col("node").alias("home"), F.col("shingles").alias("held"))
        guests = sets.select("node", F.explode("homes").alias("home"), "shingles").filter("node <> home")
        both = guests.join(own, "home").withColumn("both", F.size(F.array_intersect("shingles", "held")))
        either = F.size("shingles") + F.size("held") - F.col("both")
        similar = both.filter(F.col("both") / either >= similarity).select(F.least("node", "home").alias("a"), F.greatest("node", "home").alias("b"))
        similar = scratch.cut(similar)
        scratch.drop(sets, asked, likely, ends)
        scratch.tidy()
        return similar

    # SimHash: texts of one fingerprint meet the first of them, the first ones of linked fingerprints meet.
    prints = scratch.cut(single.groupBy("fingerprint").agg(F.min("node").alias("head")))
    alike = single.select("node", "fingerprint").join(prints, "fingerprint").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    heads = lambda end: prints.select(F.col("fingerprint").alias(end), F.col("head").alias(f"head_{end}"))
    linked = links(prints.select("fingerprint"), scratch, distance).distinct().join(heads("a"), "a").join(heads("b"), "b")
    linked = linked.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))
    simhashed = verified(alike.unionByName(linked))
    scratch.tidy()
    groups = components(simhashed, scratch).withColumnsRenamed({"component": "group"})
    # A group goes on as its star: its links are not gone over again.
    stars = lambda: groups.select(F.col("node").alias("a"), F.col("group").alias("b"))

    # ``rest``: shingles of the set from this one on.
    rows = single.select("node", "size", F.posexplode("first").alias("at", "key")).select("key", "node", "size", (F.col("size") - F.col("at")).alias("rest"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = scratch.cut(rows.join(sizes, "key"))
    scratch.tidy()
    # How much of a text is shared; all rows of a text are dealt together, and are no more than its shingles.
    shared = found.withColumn("central", F.sum("n").over(Window.partitionBy("node")) / F.col("size"))
    shared = scratch.cut(shared.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node")))
    scratch.drop(found)
    scratch.tidy()

    turn = F.xxhash64("node")
    heads = shared.groupBy("key").agg(
        F.max(F.struct("central", "node", "size", "rest", "group")).alias("most"), F.min(F.struct(turn.alias("turn"), "node", "size", "rest", "group")).alias("least"))
    heads = heads.select("key", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"{h}.{c}").alias(c) for c in ("node", "size", "rest", "group")]) for h in ("most", "least")]))).alias("h"))
    met = shared.join(heads, "key").filter((F.col("group") != F.col("h.group")) & reach(F.col("size"), F.col("rest"), F.col("h.size"), F.col("h.rest")))
    met = met.select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct()

    # What the leaders left apart: all pairs of a key in different components.
    groups = components(verified(met).unionByName(stars()), scratch).withColumnsRenamed({"component": "group"})
    scratch.tidy()
    apart = shared.drop("group").join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    open_keys = apart.groupBy("key").agg((F.min("group") < F.max("group")).alias("open")).filter("open").select("key")
    apart = scratch.cut(apart.join(open_keys, "key").select("key", "node", "size", "rest", "group", F.ceil(F.col("n") / crowd).cast("int").alias("parts")))
    scratch.drop(shared)
    a = apart.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("a")
    b = apart.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.group") != F.col("b.group"))
    met = a.join(b, on & reach(F.col("a.size"), F.col("a.rest"), F.col("b.size"), F.col("b.rest")))
    left = verified(met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct())
    scratch.drop(apart)

    found = components(left.unionByName(stars()), scratch)
    named = found.join(single.select("node", "text_key"), "node")
    names = named.groupBy("component").agg(F.min("text_key").alias("name"))
    return named.join(names, "component").select("text_key", F.col("name").alias("component"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near copies and of each text: the one with the smallest id (null ids last).

    A row that is fully repeated, and a text of several rows with the chosen id, stays once: which of the rows is any of them. All other tables are deleted.
    """
    key = F.md5(F.coalesce(F.col("text"), F.lit("")))
    ids = docs.select(F.col("doc_id").alias("id"), key.alias("near_copy"))
    with Scratch(docs.sparkSession) as scratch:
        groups = near_copies(docs, scratch, **options)
        named = ids.join(groups, ids["near_copy"] == groups["text_key"], "left").withColumn("group", F.coalesce("component", "near_copy"))
        first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "near_copy"))
        kept = scratch.keep(named.groupBy("group").agg(first.alias("k")).select(F.col("k.id").alias("kept_id"), F.col("k.near_copy").alias("kept_key")))
    # The columns of the documents go through as one value, so their names can't clash. The join and the last step share their keys: one shuffle, in
    # which copies are spread by their id.
    named = lambda i: [F.coalesce(F.col(i).cast("bigint"), F.lit(0)).alias("k_id"), F.col(i).isNull().alias("k_none")]
    rows = docs.select(key.alias("k_text"), *named("doc_id"), F.struct(*docs.columns).alias("row"))
    wanted = kept.select(F.col("kept_key").alias("k_text"), *named("kept_id"))
    keys = ["k_text", "k_id", "k_none"]
    return rows.join(wanted, keys, "left_semi").dropDuplicates(keys).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
