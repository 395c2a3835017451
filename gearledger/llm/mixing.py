"""Mixing sources to target weights.

Words are packed into fixed-length blocks per source. The mix is a sequence of slots, cut into output shards of
``shard_slots``; each slot takes one block. The source counts of the shards are a multinomial draw conditioned on every
source meeting its quota: the slots are permuted pseudorandomly and each source takes a range of the permuted slots. (A
plain draw misses a target by the root of its slots and can ask a source for more than it may give.) The n-th slot of a
source takes the block whose position in the source's own pseudorandom permutation is n, a second round begins when all
are taken. Slots and blocks meet by an equi-join on the permuted slot number, which is unique per block and round.

Both permutations are Feistel networks over a square of at least the needed size, walked until they fall inside it, so
they are computed per row from a seed: nothing is sorted, and reruns agree. Word offsets within a source are sums per
(source, bucket of ids), so a source that holds a third of all rows is spread over buckets.

Defined results: a null text has no words, its row is kept with nothing taken. The null source is a source of its own,
last in order. Repeated rows are rows of their own. If there are no words, every target is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearledger.llm.common import WORD, cut_lineage

ROUNDS = 4
#: Steps of the walk. A square of side m leaves at most 2m + 1 cells outside, so this always ends for m <= 31 and fails with a chance below (2/m)**64 beyond.
WALK = 64


def permuted(index: Column, size: Column, seed: Column) -> Column:
    """Position of ``index`` in a pseudorandom permutation of 0 .. size - 1."""
    side = F.ceil(F.sqrt(size.cast("double"))).cast("bigint")
    side = F.greatest(F.when(side * side < size, side + 1).otherwise(side), F.lit(1).cast("bigint"))

    def network(value: Column) -> Column:
        right = F.pmod(value, side)
        left = F.floor((value - right) / side).cast("bigint")
        cell = F.struct(left.alias("l"), right.alias("r"))
        for turn in range(ROUNDS):
            cell = F.transform(F.array(cell), lambda c, turn=turn: F.struct(
                c["r"].alias("l"), F.pmod(c["l"] + F.pmod(F.xxhash64(c["r"], F.lit(turn), seed), side), side).alias("r")))[0]
        return F.transform(F.array(cell), lambda c: c["l"] * side + c["r"])[0]

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), network(index), lambda at, _: F.when(at < size, at).otherwise(network(at)))
    return walk


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Target words of each source (source, source_size), one row per source.

    A source's share by weight stops at ``most`` times its size; what it can't take goes to the others by weight. Sources
    in order of cap over weight: those before the point where the common factor no longer exceeds that ratio are capped.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("source_rank", rank).withColumn("weight", F.get(listed, F.pmod("source_rank", F.lit(len(weights)))))
    rows = rows.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    goal = F.lit(float(share)) * F.sum("source_size").over(everything)
    factor = (goal - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    rows = rows.withColumn("factor", factor).withColumn("capped", F.col("factor") * F.col("weight") >= F.col("cap"))
    # The factor never falls along this order, so the first source that isn't capped sets it for all that follow.
    common = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "source_rank", "factor"))).over(everything)
    rows = rows.withColumn("common", common["factor"])
    return rows.select(
        "source", "source_rank", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("common") * F.col("weight")).alias("target"),
    )


def place(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 64,
    bucket_rows: int = 4096,
) -> DataFrame:
    """Every document with its size, its word offset within its source, and the figures of its source."""
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"))
    sized = cut_lineage(sized.select("doc_id", "source", "size", F.xxhash64("text").alias("text_key")))
    buckets = F.lit(-(-sized.count() // bucket_rows) or 1)
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key"), buckets))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("bucket_start"))
    totals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    # Words of each round: all of the source in the first, what the target leaves in the second.
    whole = F.round("target").cast("bigint")
    first = F.least(whole, F.col("source_size"))
    b = F.lit(block_words)
    totals = totals.withColumns({"blocks": F.ceil(F.col("source_size") / b).cast("bigint"), "words_0": first, "words_1": whole - first})
    # A round of a source needs at most this many slots: its short block may come early, so one more than the words fill.
    totals = totals.withColumns({f"slots_{i}": F.least(F.col("blocks"), F.ceil(F.col(f"words_{i}") / b).cast("bigint") + 1) for i in (0, 1)})
    totals = totals.withColumns({f"slots_{i}": F.when(F.col(f"words_{i}") > 0, F.col(f"slots_{i}")).otherwise(F.lit(0)) for i in (0, 1)})
    line = Window.orderBy("source_rank")
    used = F.col("slots_0") + F.col("slots_1")
    totals = totals.withColumns({"first_slot": F.sum(used).over(line) - used, "all_slots": F.sum(used).over(Window.partitionBy())})
    in_bucket = Window.partitionBy("source", "bucket").orderBy("doc_id", "text_key")
    rows = sized.withColumns({
        "number": F.row_number().over(in_bucket),
        "in_bucket": F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"),
    })
    starts = starts.join(totals, starts["source"].eqNullSafe(totals["source"]), "inner").drop(totals["source"])
    joined = rows.join(starts, rows["source"].eqNullSafe(starts["source"]) & (rows["bucket"] == starts["bucket"]), "inner")
    return joined.select(
        "doc_id", "text_key", rows["source"], rows["bucket"], "number", "size", "source_size", "target", "source_rank", "blocks", "words_0", "words_1",
        "slots_0", "slots_1", "first_slot", "all_slots", (F.col("bucket_start") + F.col("in_bucket")).alias("word_start"),
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 64,
    shard_slots: int = 4096, seed: int = 7, bucket_rows: int = 4096,
) -> DataFrame:
    """The manifest of the mix of ``docs`` (doc_id, source, text): one row per document and block it shares in, per round.

    Columns: those of ``place``, then shard, slot (place in the mix), start and length (words of the document that
    go there). A document that the mix doesn't take has rows with a null slot and length 0.
    """
    if most > 2:
        raise ValueError("a block is taken twice at most")
    placed = cut_lineage(place(docs, weights, share, most, block_words, bucket_rows))
    b = F.lit(block_words)
    first, last = F.floor(F.col("word_start") / b), F.floor((F.col("word_start") + F.col("size") - 1) / b)
    blocks = F.when(F.col("size") > 0, F.sequence(first.cast("bigint"), last.cast("bigint")))
    # The rows are short and give many pieces each, so they are dealt out evenly before.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = placed.repartition(parts, "doc_id", "text_key").withColumn("block", F.explode_outer(blocks))
    pieces = pieces.withColumn("position", permuted(F.col("block"), F.col("blocks"), F.xxhash64(F.lit(seed), F.col("source_rank"))))
    pieces = pieces.withColumn("short", permuted(F.col("blocks") - 1, F.col("blocks"), F.xxhash64(F.lit(seed), F.col("source_rank"))))
    short = pieces["blocks"] * b - pieces["source_size"]
    # Words of the round that come before this block: full blocks, but for the source's last one, if it came already.
    pieces = pieces.withColumn("before", F.col("position") * b - F.when(F.col("short") < F.col("position"), short).otherwise(F.lit(0)))
    from_word = F.greatest("word_start", F.col("block") * b)
    to_word = F.least(F.col("word_start") + F.col("size"), (F.col("block") + 1) * b)
    pieces = pieces.withColumns({"from_word": from_word, "to_word": to_word})
    rounds = F.array(*[F.struct(F.lit(i).alias("round"), F.col(f"words_{i}").alias("words"), F.col(f"slots_{i}").alias("slots")) for i in (0, 1)])
    pieces = pieces.withColumn("r", F.explode(rounds))
    # The last block of a round may be cut; only its first words are taken.
    end = F.least("to_word", F.col("block") * b + F.col("r.words") - F.col("before"))
    pieces = pieces.withColumn("length", F.greatest(F.coalesce(end - F.col("from_word"), F.lit(0)), F.lit(0)))
    index = F.col("first_slot") + F.when(F.col("r.round") == 0, F.lit(0)).otherwise(F.col("slots_0")) + F.col("position")
    # Pieces that no slot takes get numbers below zero that no slot has, each its own, so they don't meet in one task.
    idle = -1 - F.abs(F.xxhash64("doc_id", "bucket", "number", "block", "r.round") % F.lit(2**62))
    pieces = pieces.withColumn("index", F.when((F.col("length") > 0) & (F.col("position") < F.col("r.slots")), index).otherwise(idle))
    spark = docs.sparkSession
    top = placed.agg(F.max("all_slots")).first()[0] or 0
    slots = spark.range(top).withColumnRenamed("id", "slot").withColumn("index", permuted(F.col("slot"), F.lit(top), F.xxhash64(F.lit(seed), F.lit(-1))))
    mixed = pieces.join(slots, "index", "left")
    return mixed.select(
        *placed.columns, F.floor(F.col("slot") / shard_slots).alias("shard"), "slot", F.col("r.round").alias("round"),
        F.when(F.col("slot").isNotNull(), F.col("from_word") - F.col("word_start")).alias("start"),
        F.when(F.col("slot").isNotNull(), F.col("length")).otherwise(F.lit(0)).cast("bigint").alias("length"),
    )


def mixed_sizes(manifest: DataFrame) -> DataFrame:
    """Words that the mix takes of every document: doc_id, size, source_size, target, taken."""
    keys = ("source_rank", "bucket", "number", "doc_id", "size", "source_size", "target")
    return manifest.groupBy(*keys).agg(F.sum("length").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def _pieces(text: Column) -> tuple[Column, Column]:
    """The words of a text and the white space before each of them, then that behind the last one."""
    return F.regexp_extract_all(text, F.lit(WORD), 0), F.split(text, WORD, -1)


def _written(words: Column, gaps: Column, ranges: Column) -> Column:
    """The words of some ranges (start, length) with the white space that stands between them in the text; a line break between ranges that don't touch."""
    def one(r: Column) -> Column:
        start, length = r["start"].cast("int"), r["length"].cast("int")
        inner = F.zip_with(F.slice(words, start + 1, length), F.slice(gaps, start + 1, length), lambda w, g: F.concat(F.coalesce(g, F.lit("")), w))
        # The white space before the first word is that of the text only if the range before ends there.
        return F.struct(start.alias("start"), (start + length).alias("end"), F.array_join(inner, "").alias("text"), F.length(F.get(gaps, start)).alias("lead"))

    def joined(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda p, i: F.when((i > 0) & (F.get(parts, i - 1)["end"] == p["start"]), p["text"]).otherwise(
            F.concat(F.when(i > 0, "\n").otherwise(""), F.substring(p["text"], p["lead"] + 1, F.length(p["text"]))))), "")

    return F.transform(F.array(F.transform(ranges, one)), joined)[0]


def mixed_documents(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """The documents of a mix, with the columns of ``docs``: a row per document and round with the words taken of it.

    A document that is taken whole keeps its text, else the taken words stand in their order with the white space between them; where words are
    left out between, a line break stands. n_chars, where there is such a column, is counted anew. A text is moved once and cut into words once,
    for both rounds. Fully repeated rows are told apart by the manifest only, so one of them gives the texts of all.
    """
    key = lambda text: [F.xxhash64("doc_id", "source", text).alias("k1"), F.xxhash64(text, "source", "doc_id").alias("k2")]
    taken = manifest.filter("length > 0").groupBy("doc_id", "text_key", "source", "source_rank", "bucket", "number", "size", "round").agg(
        F.sum("length").alias("words"), F.array_sort(F.collect_list(F.struct("start", "length"))).alias("ranges"))
    copies = taken.select(*key("text_key"), F.struct("round", "size", "words", "ranges").alias("copy"), "bucket", "number")
    copies = copies.groupBy("k1", "k2", "bucket", "number").agg(F.array_sort(F.collect_list("copy")).alias("copies"))
    # Repeated rows collapse before the shuffle; the join finds the rows where that left them.
    held = docs.select(*key(F.xxhash64("text")), F.struct(*docs.columns).alias("row")).dropDuplicates(["k1", "k2"])
    rows = copies.join(held, ["k1", "k2"])
    words, gaps = _pieces(F.col("row.text"))
    # Words and gaps are bound once for all copies.
    bound = F.transform(F.array(F.struct(words.alias("words"), gaps.alias("gaps"))), lambda t: F.transform("copies", lambda c: F.when(
        c["words"] == c["size"], F.col("row.text")).otherwise(_written(t["words"], t["gaps"], c["ranges"]))))[0]
    out = rows.select("row", F.explode(bound).alias("text"))
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return out.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
