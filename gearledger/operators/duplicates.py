"""Duplicate candidates of one brand: ``0.85 * Jaccard(name words) + 0.15`` when part numbers are prefix-related.

Copies of one name are never paired with each other. Records collapse to name groups (brand, set of words);
a copy is listed once with the representative of its group, and pairs are made between groups only. Pairs come
from an exact prefix-filter join on the rarest words: two sets whose Jaccard reaches ``t`` must share a word
among the first ``n - ceil(t * n) + 1`` words of each when words are ordered from rare to common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearledger.functions.text import fold_text, normalize_identifier, tokens

NAME_WEIGHT, PREFIX_BONUS, TOP_SCORE = 0.85, 0.15, 0.99
PREFIX_LENGTH = 6


def name_members(records: DataFrame) -> DataFrame:
    """(record_id, group_id, brand, words, part_numbers) of every record. The group id is a hash of brand and words."""
    words = F.array_sort(tokens(F.col("name")))
    group = F.sha2(F.concat_ws("|", fold_text(F.col("brand")), F.array_join(words, " ")), 256)
    numbers = F.filter(
        F.array_distinct(F.transform("part_numbers", normalize_identifier)), lambda n: F.length(n) >= PREFIX_LENGTH
    )
    return records.select(
        "record_id", group.alias("group_id"), fold_text(F.col("brand")).alias("brand"), words.alias("words"), numbers.alias("numbers")
    )


def name_groups(members: DataFrame) -> DataFrame:
    """One row per name group: representative and number of copies."""
    return members.groupBy("group_id", "brand").agg(
        F.min("words").alias("words"), F.min("record_id").alias("representative"), F.count("*").alias("copies")
    )


def copies(records: DataFrame) -> DataFrame:
    """Every record that repeats a name of its brand, beside the representative of its group.

    Columns: representative, record_id, copies, linked (their part numbers are prefix-related) and the exact score
    of the two records, whose name words are equal.
    """
    members = name_members(records)
    groups = name_groups(members).filter(F.col("copies") > 1).select("group_id", "representative", "copies")
    first = members.select(F.col("record_id").alias("representative"), F.col("numbers").alias("first_numbers"))
    found = members.join(groups, "group_id").filter(F.col("record_id") != F.col("representative")).join(first, "representative")
    related = F.exists("numbers", lambda n: F.exists("first_numbers", lambda m: F.startswith(n, m) | F.startswith(m, n)))
    score = F.when(related, F.lit(TOP_SCORE)).otherwise(F.lit(NAME_WEIGHT))
    return found.select("representative", "record_id", "copies", related.alias("linked"), score.alias("score"))


def _rare_first(groups: DataFrame) -> DataFrame:
    """Words of each group from rare to common."""
    words = groups.select("group_id", F.explode("words").alias("word"))
    weight = words.groupBy("word").agg(F.count("*").alias("uses"))
    ordered = words.join(weight, "word").groupBy("group_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("uses", "word"))), lambda x: x["word"]).alias("ordered")
    )
    return groups.join(ordered, "group_id")


def _jaccard(left: Column, right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right))
    return shared / (F.size(left) + F.size(right) - shared)


def similar_groups(groups: DataFrame, threshold: float) -> DataFrame:
    """Pairs of name groups of one brand whose Jaccard reaches ``threshold`` (> 0), left id below right id."""
    ordered = _rare_first(groups)
    n = F.size("ordered")
    # A tiny slack keeps an exact multiple from being rounded up past itself.
    keep = n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    probes = ordered.select("group_id", "brand", "words", n.alias("n"), F.explode(F.slice("ordered", F.lit(1), keep)).alias("word"))
    left = probes.select(*[F.col(c).alias(f"l_{c}" if c not in ("brand", "word") else c) for c in probes.columns])
    right = probes.select(*[F.col(c).alias(f"r_{c}" if c not in ("brand", "word") else c) for c in probes.columns])
    sized = (F.col("l_n") >= F.col("r_n") * threshold - 1e-9) & (F.col("r_n") >= F.col("l_n") * threshold - 1e-9)
    met = left.join(right, ["brand", "word"]).filter((F.col("l_group_id") < F.col("r_group_id")) & sized)
    scored = met.withColumn("jaccard", _jaccard(F.col("l_words"), F.col("r_words"))).filter(F.col("jaccard") >= threshold - 1e-9)
    return scored.select(
        F.col("l_group_id").alias("left_group"), F.col("r_group_id").alias("right_group"), "jaccard"
    ).distinct()


def prefix_numbers(members: DataFrame) -> DataFrame:
    """Distinct part numbers of a brand where ``short`` starts ``long`` (or equals it).

    Every number meets its own prefixes by equality, so only true relations are produced.
    """
    numbers = members.select("brand", F.explode("numbers").alias("number")).distinct()
    prefixes = numbers.select(
        "brand", F.col("number").alias("long"),
        F.explode(F.transform(F.sequence(F.lit(PREFIX_LENGTH), F.length("number")), lambda k: F.substring("number", F.lit(1), k))).alias("short"),
    )
    return prefixes.join(numbers.withColumnRenamed("number", "short"), ["brand", "short"])


def _linked(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The given group pairs that hold a prefix-related pair of part numbers."""
    owned = members.select("group_id", "brand", F.explode("numbers").alias("number")).distinct()
    relation = prefix_numbers(members)
    both = relation.select("brand", F.col("long").alias("number"), F.col("short").alias("other")).unionByName(
        relation.select("brand", F.col("short").alias("number"), F.col("long").alias("other"))
    ).distinct()
    reach = pairs.join(owned.withColumnRenamed("group_id", "left_group"), "left_group").join(both, ["brand", "number"])
    target = owned.select(F.col("group_id").alias("right_group"), F.col("number").alias("other"))
    return reach.join(target, ["right_group", "other"], "left_semi").select("left_group", "right_group").distinct()


def duplicate_pairs(records: DataFrame, min_score: float) -> DataFrame:
    """Pairs of name groups whose best record pair scores at least ``min_score`` (> 0.15).

    Columns: left_id, right_id (representatives), left_copies, right_copies, jaccard, linked, score. The score is
    the highest any record of one group reaches with any record of the other.
    """
    if min_score <= PREFIX_BONUS:
        raise ValueError(f"min_score must be above {PREFIX_BONUS}: pairs without a common word are not looked for")
    members = name_members(records)
    groups = name_groups(members)
    low = (min_score - PREFIX_BONUS) / NAME_WEIGHT
    pairs = similar_groups(groups, low)
    linked = _linked(pairs.select("left_group", "right_group"), members).withColumn("linked", F.lit(True))
    marked = pairs.join(linked, ["left_group", "right_group"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    score = F.least(
        F.lit(TOP_SCORE),
        F.round(F.col("jaccard") * NAME_WEIGHT + F.when(F.col("linked"), F.lit(PREFIX_BONUS)).otherwise(F.lit(0.0)), 4),
    )
    side = lambda p: groups.select(
        F.col("group_id").alias(f"{p}_group"), F.col("representative").alias(f"{p}_id"), F.col("copies").alias(f"{p}_copies")
    )
    return marked.withColumn("score", score).filter(F.col("score") >= min_score).join(
        side("left"), "left_group"
    ).join(side("right"), "right_group").select(
        F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"),
        F.when(F.col("left_id") < F.col("right_id"), F.col("left_copies")).otherwise(F.col("right_copies")).alias("left_copies"),
        F.when(F.col("left_id") < F.col("right_id"), F.col("right_copies")).otherwise(F.col("left_copies")).alias("right_copies"),
        "jaccard", "linked", "score",
    )
