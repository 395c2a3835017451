"""Exact substring duplicates by a logarithmic family of sparse suffix arrays.

Every byte that a ``window``-byte string covers is removed if that string also starts anywhere else.

*Sparse suffix array.* Of the ``gram``-byte strings inside a window the one with the least hash (the leftmost of equals) is the
window's anchor; equal windows have equal anchors at equal places, so only suffixes that start at anchors are indexed, one in
about ``(window - gram) / 2`` bytes. A suffix is represented by the hash of its first ``gram`` bytes and by the hash of its
segment, the union of the windows it is the anchor of. Arrays are ordered by these hashes, not by the bytes: the hash order is
even, whatever the text, so arrays split into equal buckets.

*Index family.* A batch's array is merge-scanned (a join of co-partitioned, sorted buckets, without a shuffle) against every
existing level; keys found there are long-match candidates. Then it becomes a level, and levels of equal size merge
geometrically, so a key is rewritten a logarithmic number of times.

*Verification.* All places of a candidate key with one segment are equal in every window. Where a key has several segments, the
windows of one place of each segment are hashed and counted within the key. A key with more than ``crowd`` segments is dealt
over tasks by window hash. Nothing is capped: counts are combined before shuffles, joins on frequent keys can be split.

Defined results: a null text is empty; texts shorter than a window are kept whole; the same string at two places of one document
counts, overlaps included. Rows are told apart by 80 bits of their id and text, so null and repeated ids need no rule; fully repeated rows are
treated alike. Strings are compared by two 64-bit hashes, of the anchor and of the segment or window, both read off one
polynomial modulo 2**64: a false match is unlikely in ordinary texts (results equal brute force on all bytes of sf0.01), but no bound is proven.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearledger.llm.common import cut_lineage, discard, stored, text_or_empty

BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64(0xFFFFFFFF)


class Hashes:
    """Polynomial hashes (modulo 2**64) of all strings of a buffer, read off running sums."""

    def __init__(self, data: np.ndarray) -> None:
        values = (np.arange(1, 257, dtype=np.uint64) * GOLDEN)
        values ^= values >> np.uint64(29)
        values = values * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1)
        up, self.down = np.full(len(data) + 1, BASE), np.full(len(data) + 1, INVERSE)
        up[0] = self.down[0] = 1
        up, self.down = np.cumprod(up), np.cumprod(self.down)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (self.sums[end] - self.sums[start]) * self.down[start]
        out ^= out >> np.uint64(32)
        return out * GOLDEN


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` values in a row (blockwise running minima from both sides)."""
    padded = np.full(-(-len(values) // width) * width, np.uint64(2**64 - 1))
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: len(values) - width + 1], left[width - 1: len(values)])


def anchors(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, key, segment hash, first window, anchor offset in it, windows after the first) of every anchor of some texts."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    none = np.zeros(0, dtype=np.int64)
    if len(data) < window:
        return none, none, none, none, none, none
    hashes = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    key = hashes.of(at, at + gram)
    # The upper half of the hash decides, then the place, so the least is the leftmost of equals.
    ranked = (key & ~LOW) | at.astype(np.uint64)
    anchor = (_sliding_least(ranked, window - gram + 1) & LOW).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(bounds, start, side="right") - 1
    inside = start + window <= bounds[text + 1]
    start, anchor, text = start[inside], anchor[inside], text[inside]
    if not len(start):
        return none, none, none, none, none, none
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    a, b, text, anchor = start[first], start[last], text[first], anchor[first]
    segment = hashes.of(a, b + window)
    return text, key[anchor].view(np.int64), segment.view(np.int64), a - bounds[text], anchor - a, b - a


def _chunks(texts: list, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes of texts each; a longer text is alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key without nulls: a hash of id and text, and 16 bits of another one."""
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("doc_id").isNull(), "doc_id", text).alias("row_id"),
        F.xxhash64(text, F.col("doc_id").isNull(), "doc_id").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("row_tag"), text.alias("text"),
    )


def suffixes(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The anchors of every row: key, segment, row_id, place (first window, row tag, anchor offset and run packed in one long)."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in frame["text"]]
            ids, tags = frame["row_id"].to_numpy(np.int64), frame["row_tag"].to_numpy(np.int64)
            for i, j in _chunks(texts, 1 << 20):
                text, key, segment, first, offset, run = anchors(texts[i:j], window, gram)
                place = (first << 32) | (tags[i + text] << 16) | (offset << 8) | run
                yield pd.DataFrame({"key": key, "segment": segment, "row_id": ids[i + text], "place": place})

    if not 1 <= window - gram < 256:
        raise ValueError("window - gram must be between 1 and 255")
    return _keyed(docs).select("row_id", "row_tag", "text").mapInPandas(made, "key bigint, segment bigint, row_id bigint, place bigint")


class IndexFamily:
    """Levels of keys with their number of places, as tables bucketed and sorted by key. Batches are added one by one."""

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark, self.name = spark, f"llm_suffixes_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str]] = []  # (rank, table), largest first
        self.written = 0
        self.found: list[DataFrame] = []

    def _write(self, rows: DataFrame) -> str:
        self.written += 1
        name = f"{self.name}_{self.written}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name, format="parquet")
        return name

    def add(self, places: DataFrame) -> None:
        """Scan a batch (key per place) against all levels, then make it a level and merge levels of equal rank."""
        fresh = self._write(places.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
        rows = self.spark.table(fresh)
        hits = [rows.filter("n > 1").select("key")]
        hits += [rows.join(self.spark.table(level), "key", "left_semi").select("key") for _, level in self.levels]
        for more in hits[1:]:
            hits[0] = hits[0].unionByName(more)
        self.found.append(cut_lineage(hits[0].distinct()))
        self.levels.append((0, fresh))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            left, right = self.spark.table(a), self.spark.table(b).withColumnRenamed("n", "m")
            both = left.join(right, "key", "full_outer").select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
            self.levels.append((rank + 1, self._write(both)))
            for old in (a, b):
                self.spark.sql(f"DROP TABLE {old}")

    def candidates(self) -> DataFrame:
        """Keys with more than one place so far."""
        keys = self.found[0]
        for more in self.found[1:]:
            keys = keys.unionByName(more)
        return cut_lineage(keys.distinct())

    def drop(self) -> None:
        for _, level in self.levels:
            self.spark.sql(f"DROP TABLE {level}")
        self.levels = []


def _window_counts(frame: pd.DataFrame, window: int) -> pd.DataFrame:
    """Which windows of the segments of some keys occur more than once. Rows: key, segment, shape, n, payload (bytes, or hashes and offsets)."""
    plain = frame["part"].to_numpy() < 0
    keys, hashes, offsets, owners = [], [], [], []
    payloads, runs = frame["payload"].tolist(), (frame["shape"].to_numpy(np.int64) & 255)
    texts = [p for p, yes in zip(payloads, plain, strict=True) if yes]
    if texts:
        number = np.flatnonzero(plain)
        table = Hashes(np.frombuffer(b"".join(texts), dtype=np.uint8))
        begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
        count = runs[number] + 1
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(begin, count) + offset
        hashes.append(table.of(at, at + window))
        offsets.append(offset)
        owners.append(np.repeat(number, count))
    for i in np.flatnonzero(~plain):
        packed = np.frombuffer(payloads[i], dtype=[("h", "<u8"), ("o", "u1")])
        hashes.append(packed["h"].astype(np.uint64))
        offsets.append(packed["o"].astype(np.int64))
        owners.append(np.full(len(packed), i))
    h, offset, owner = np.concatenate(hashes), np.concatenate(offsets), np.concatenate(owners)
    key = frame["key"].to_numpy(np.int64)[owner]
    order = np.lexsort((h, key))
    h, offset, owner, key = h[order], offset[order], owner[order], key[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
    total = np.add.reduceat(frame["n"].to_numpy(np.int64)[owner], np.flatnonzero(first))
    again = total[np.cumsum(first) - 1] > 1
    owner, offset = owner[again], offset[again]
    order = np.lexsort((offset, owner))
    owner, offset = owner[order], offset[order]
    if not len(owner):
        return pd.DataFrame({"key": [], "segment": [], "shape": [], "spans": []})
    # Runs of neighbouring windows make one span.
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(owner)]]) - 1
    spans = pd.DataFrame({"i": owner[new], "a": offset[new], "b": offset[last] + window})
    spans = spans.groupby("i")[["a", "b"]].agg(list)
    out = frame.iloc[spans.index][["key", "segment", "shape"]].copy()
    out["spans"] = [[v for pair in zip(a, b, strict=True) for v in pair] for a, b in zip(spans["a"], spans["b"], strict=True)]
    return out


def repeated_spans(docs: DataFrame, window: int = 200, gram: int = 64, batches: int = 4, crowd: int = 4096) -> DataFrame:
    """(row_id, row_tag, spans) of every row of ``docs`` that holds repeated windows; spans is a flat list of starts and ends in bytes, unsorted."""
    places, path = stored(suffixes(docs, window, gram))
    family = IndexFamily(docs.sparkSession)
    for i in range(batches):
        family.add(places.filter(F.pmod(F.xxhash64("row_id"), F.lit(batches)) == i))
    candidates = family.candidates()
    family.drop()
    shape = F.col("place").bitwiseAND(F.lit(0xFFFF)).alias("shape")
    found = cut_lineage(places.join(candidates, "key").select("key", "segment", "row_id", "place", shape))
    discard(docs.sparkSession, path)
    kinds = found.groupBy("key", "segment", "shape").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_id", "place")).alias("one"))
    kinds = cut_lineage(kinds)
    sizes = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))
    alone = kinds.join(sizes.filter("kinds = 1"), "key").select("key", "segment", "shape")
    # One segment only: all its places are equal, from its first window to its last.
    alone = alone.withColumn("spans", F.array(F.lit(0), (F.col("shape").bitwiseAND(F.lit(255)) + window).cast("int")))
    several = kinds.join(sizes.filter("kinds > 1"), "key").select(
        F.col("one.row_id").alias("row_id"), F.shiftright("one.place", 16).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("row_tag"),
        F.struct(F.shiftright("one.place", 32).alias("at"), "key", "segment", "shape", "n", F.ceil(F.col("kinds") / crowd).cast("int").alias("parts")).alias("s"),
    )
    several = several.groupBy("row_id", "row_tag").agg(F.collect_list("s").alias("segments"))
    texts = _keyed(docs)

    def cut(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches_:
            rows = []
            for text, segments in zip(frame["text"], frame["segments"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for s in segments:
                    at, run = s["at"], s["shape"] & 255
                    piece, head = data[at: at + run + window], (s["key"], s["segment"], s["shape"], s["n"])
                    if s["parts"] == 1:
                        rows.append((*head, -1, piece))
                        continue
                    table, first = Hashes(np.frombuffer(piece, dtype=np.uint8)), np.arange(run + 1)
                    packed = np.zeros(run + 1, dtype=[("h", "<u8"), ("o", "u1")])
                    packed["h"], packed["o"] = table.of(first, first + window), first
                    part = (packed["h"] >> np.uint64(20)) % np.uint64(s["parts"])
                    rows += [(*head, int(p), packed[part == p].tobytes()) for p in np.unique(part)]
            if rows:
                yield pd.DataFrame(rows, columns=["key", "segment", "shape", "n", "part", "payload"])

    def counted(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in batches_:
            held.append(frame)
            if sum(map(len, held)) < 20_000:
                continue
            rows = pd.concat(held, ignore_index=True)
            # Rows come by key and part; the last group may go on in the next batch.
            end = (rows["key"].iloc[-1], rows["part"].iloc[-1])
            open_ = ((rows["key"] == end[0]) & (rows["part"] == end[1])).to_numpy()
            if not open_.all():
                yield _window_counts(rows[~open_].reset_index(drop=True), window)
            held = [rows[open_]]
        if held:
            yield _window_counts(pd.concat(held, ignore_index=True), window)

    bytes_ = texts.join(several, ["row_id", "row_tag"]).select("text", "segments").mapInPandas(
        cut, "key bigint, segment bigint, shape bigint, n bigint, part int, payload binary")
    dealt = bytes_.repartition("key", "part").sortWithinPartitions("key", "part")
    checked = dealt.mapInPandas(counted, "key bigint, segment bigint, shape bigint, spans array<int>")
    verdict = alone.unionByName(checked)
    first = F.shiftright("place", 32)
    marks = found.join(verdict, ["key", "segment", "shape"]).select(
        "row_id", F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("row_tag"),
        F.transform("spans", lambda s: (s + first).cast("int")).alias("spans"))
    return marks.groupBy("row_id", "row_tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = 200, gram: int = 64, batches: int = 4, crowd: int = 4096) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, n_bytes, removed (array of start, end in bytes) and kept (the remaining bytes)."""
    marks = repeated_spans(docs, window, gram, batches, crowd)
    rows = _keyed(docs).join(marks, ["row_id", "row_tag"], "left").select("doc_id", "text", "spans")

    def removed(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches_:
            out = []
            for doc, text, spans in zip(frame["doc_id"].astype("Int64"), frame["text"], frame["spans"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                runs: list[list[int]] = []
                if spans is not None and len(spans):
                    pairs = np.asarray(spans, dtype=np.int64).reshape(-1, 2)
                    for a, b in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                out.append((doc, len(data), [{"start": a, "end": b} for a, b in runs], b"".join(kept)))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "removed", "kept"]).astype({"doc_id": "Int64"})

    return rows.mapInPandas(removed, "doc_id bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")
