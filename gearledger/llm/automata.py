"""Repeated word sequences by suffix automata of reference shards.

Every word that a window of ``length`` consecutive words covers is removed if the same word sequence also starts anywhere else.

*Reference.* Of the ``gram``-word strings of a window the one with the least hash (the leftmost of equals) is its anchor; equal windows
have equal anchors at equal places. Consecutive windows of one anchor form a run, so every window lies in exactly one run,
and a window can only be repeated by runs of the same anchor. Runs are counted by their content; those whose anchor
occurs once leave. What stays, each content once with its number of occurrences, is the reference.

*Shards and automata.* The reference is cut by anchor into shards of about ``shard_words`` words. A shard's suffix automaton, with the number of
occurrences of each state, tells for every position of a streamed run the longest word string that ends there and occurs twice
or more (its matching statistics). Where that is ``length`` or more, the window is removed; the spans of overlapping windows are maximal.

*Departure.* An automaton is sent to the texts that hold one of its anchors, not broadcast to all: streaming all documents past all
shards would be documents times shards, and the automata together grow with the corpus. As equal runs have equal statistics,
each content is streamed once, beside its automaton, and the spans found go back to all places of that content.

*Exact way for crowded anchors.* An anchor with over ``crowd`` different runs (a frequent phrase in ever new surroundings) would fill a shard: its
windows are counted by two hashes instead, in arrays; with over 16 times as many runs they are dealt over several tasks by their hash.

Defined results: a null text has no words; texts shorter than a window stay as they are; overlapping windows count as occurrences, within one
document too. Rows are worked on by their text, so null and repeated ids, and repeated rows, need no rule: equal texts repeat each other and
are treated alike. Kept words are joined by one blank. Words are compared by a 64-bit polynomial hash, runs of one anchor by another 64 bits, counted windows by
128 bits over the words' hashes: a false match is unlikely, but no bound is proven. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearledger.llm.common import discard, stored, text_or_empty

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
GOLDEN = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
LOW = np.uint64((1 << 32) - 1)
RUN = "t1 bigint, t2 bigint, key bigint, digest bigint, start bigint, words int"
FOUND = "key bigint, digest bigint, spans array<int>"


class Ids:
    """64-bit hash of every word of a text: a polynomial over its bytes modulo 2**64, read off running sums, then mixed. Powers are kept."""

    def __init__(self) -> None:
        self.values = np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN)
        self.values ^= self.values >> np.uint64(29)
        self.values = self.values * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The hash and the first byte of every word."""
        raw = np.frombuffer(data, dtype=np.uint8)
        if len(raw) >= len(self.up):
            size = max(1 << 16, 1 << len(raw).bit_length())
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, dtype=np.uint64)])) for base in (BASE, INVERSE))
        word = (raw != 32) & ((raw < 9) | (raw > 13))
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.values[raw] * self.up[: len(raw)], out=sums[1:])
        made = (sums[end] - sums[start]) * self.down[start]
        for shift in (31, 29):
            made ^= made >> np.uint64(shift)
            made *= np.uint64(0x94D049BB133111EB)
        return (made ^ (made >> np.uint64(32))).view(np.int64), start


def word_ids(data: bytes, known: Ids) -> np.ndarray:
    return known.of(data)[0]


def _pieces(data: bytes, size: int) -> Iterator[bytes]:
    """A text in pieces of some ``size`` bytes, cut at white space only."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = re.compile(rb"[\x20\x09-\x0D]").search(data, end)
            end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` values in a row, by doubling."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have:]) if width > have else values


def runs(ids: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(number of the text, key, start, words) of every run of texts that lie one behind the other, ``bounds`` apart."""
    none = np.zeros(0, dtype=np.int64)
    if len(ids) < length:
        return none, none, none, none
    grams = len(ids) - gram + 1
    key = np.zeros(grams, dtype=np.uint64)
    for j in range(gram):
        key += ids[j: j + grams].view(np.uint64) * np.uint64(pow(GOLDEN, j + 1, 1 << 64))
    key ^= key >> np.uint64(31)
    key *= np.uint64(0x94D049BB133111EB)
    key ^= key >> np.uint64(29)
    # The upper half of the hash decides, then the place, so the least is the leftmost of equals.
    anchor = (_least((key & ~LOW) | np.arange(grams, dtype=np.uint64), length - gram + 1) & LOW).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(bounds, start, side="right") - 1
    inside = start + length <= bounds[text + 1]
    start, anchor, text = start[inside], anchor[inside], text[inside]
    if not len(start):
        return none, none, none, none
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return text[first], key[anchor[first]].view(np.int64), start[first], start[last] - start[first] + length


def _signed(value: int) -> int:
    return value - ((value >> 63) << 64)


def _grouped(frame: pd.DataFrame, length: int, known: Ids, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Word ids of some texts at a time: (ids, bounds, row of the frame, number of words before the piece). Pieces of a long text overlap by ``length`` - 1 words."""
    held: list[tuple[bytes, int]] = []
    total = 0

    def short():
        # Short texts lie one behind the other in one buffer.
        offsets = np.cumsum([0, *(len(d) + 1 for d, _ in held)])
        ids, starts = known.of(b" ".join(d for d, _ in held))
        bounds = np.searchsorted(starts, offsets)
        return ids, bounds, np.array([r for _, r in held]), np.zeros(len(held), dtype=np.int64)

    for row, text in enumerate(frame["text"]):
        data = text.encode("utf-8", "surrogatepass")
        if len(data) <= size:
            held.append((data, row))
            total += len(data)
            if total > size:
                yield short()
                held, total = [], 0
            continue
        before, tail = 0, np.zeros(0, dtype=np.int64)
        for piece in _pieces(data, size):
            ids = np.concatenate([tail, word_ids(piece, known)])
            yield ids, np.array([0, len(ids)]), np.array([row]), np.array([before])
            keep = min(len(ids), length - 1)
            before, tail = before + len(ids) - keep, ids[len(ids) - keep:]
    if held:
        yield short()


def _text_key() -> list[Column]:
    return [F.xxhash64(text_or_empty()).alias("t1"), F.xxhash64(F.lit(1), text_or_empty()).alias("t2")]


def anchored_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of every row: text key, anchor key, digest of the content, first word, number of words."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Ids()
        for frame in batches:
            t1, t2 = frame["t1"].to_numpy(), frame["t2"].to_numpy()
            for ids, bounds, row, before in _grouped(frame, length, known):
                text, key, start, words = runs(ids, bounds, length, gram)
                raw = memoryview(ids).cast("B")
                digest = xxhash.xxh3_64_intdigest
                ends = (start + words) * 8
                digests = np.fromiter((_signed(digest(raw[a:b], 7)) for a, b in zip((start * 8).tolist(), ends.tolist(), strict=True)), dtype=np.int64, count=len(start))
                yield pd.DataFrame({
                    "t1": t1[row[text]], "t2": t2[row[text]], "key": key, "digest": digests,
                    "start": start - bounds[text] + before[text], "words": words.astype(np.int32),
                })

    return docs.select(*_text_key(), text_or_empty().alias("text")).mapInPandas(made, RUN)


class Automaton:
    """Suffix automaton of several word sequences with the number of places where each state's strings end."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [0]

    def _state(self, following: dict[int, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(0)
        return len(self.next) - 1

    def _split(self, state: int, at: int, symbol: int) -> int:
        """The state of the strings of ``at`` longer by ``symbol``, which lie in ``state`` beside longer ones."""
        part = self._state(self.next[state].copy(), self.link[state], self.length[at] + 1)
        self.link[state] = part
        while at >= 0 and self.next[at].get(symbol) == state:
            self.next[at][symbol] = part
            at = self.link[at]
        return part

    def add(self, sequence: list[int], times: int) -> None:
        now = 0
        for symbol in sequence:
            there = self.next[now].get(symbol)
            if there is not None:
                now = there if self.length[there] == self.length[now] + 1 else self._split(there, now, symbol)
            else:
                made, at = self._state({}, 0, self.length[now] + 1), now
                while at >= 0 and symbol not in self.next[at]:
                    self.next[at][symbol] = made
                    at = self.link[at]
                if at >= 0:
                    there = self.next[at][symbol]
                    self.link[made] = there if self.length[there] == self.length[at] + 1 else self._split(there, at, symbol)
                now = made
            self.ends[now] += times

    def count(self) -> None:
        """Carry the ends of longer strings to their suffixes."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]

    def repeated(self, sequence: list[int], length: int) -> list[int]:
        """Maximal spans (start, end, start, end, ...) covered by strings of ``length`` that end at two places or more."""
        following, link, longest, ends = self.next, self.link, self.length, self.ends
        spans: list[int] = []
        now = have = 0
        for end, symbol in enumerate(sequence, 1):
            there = following[now].get(symbol)
            while now and (there is None or ends[there] < 2):
                now = link[now]
                have = longest[now]
                there = following[now].get(symbol)
            if there is not None and ends[there] >= 2:
                now, have = there, have + 1
            if have >= length:
                if spans and spans[-1] >= end - length:
                    spans[-1] = end
                else:
                    spans += [end - length, end]
        return spans


def _shard(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    sequences = [np.frombuffer(c, dtype="<i8").tolist() for c in frame["content"]]
    automaton = Automaton()
    for sequence, times in zip(sequences, frame["n"], strict=True):
        automaton.add(sequence, int(times))
    automaton.count()
    return pd.DataFrame({"key": frame["key"], "digest": frame["digest"], "spans": [automaton.repeated(s, length) for s in sequences]})


def _contents(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Word ids of the wanted runs (t1, t2, runs), read from one row of each text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Ids()
        for frame in batches:
            for text, taken in zip(frame["text"], frame["runs"], strict=True):
                ids = np.concatenate([np.zeros(0, dtype=np.int64), *(word_ids(p, known) for p in _pieces(text.encode("utf-8", "surrogatepass"), 1 << 20))])
                yield pd.DataFrame([
                    (r["shard"], r["key"], r["digest"], r["n"], r["kinds"], ids[r["start"]: r["start"] + r["words"]].tobytes()) for r in taken
                ], columns=["shard", "key", "digest", "n", "kinds", "content"])

    one = Window.partitionBy("t1", "t2").orderBy("t1")
    single = texts.withColumn("nth", F.row_number().over(one)).filter("nth = 1").drop("nth")
    return single.join(wanted, ["t1", "t2"]).select("text", "runs").mapInPandas(read, "shard int, key bigint, digest bigint, n bigint, kinds bigint, content binary")


WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("at", "<i4")])


def _counted(contents: DataFrame, length: int, room: int) -> DataFrame:
    """Spans of the runs of crowded anchors: their windows are counted by two hashes. An anchor with over ``room`` runs is dealt over tasks by window."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                hashes = [xxhash.xxh3_128_intdigest(r.content[a:a + 8 * length]) for a in range(0, len(r.content) - 8 * length + 1, 8)]
                packed = np.array([(h >> 64, h & (1 << 64) - 1, i) for i, h in enumerate(hashes)], dtype=WINDOW)
                part = packed["a"] % np.uint64(-(-r.kinds // room))
                rows += [(r.key, int(p), r.digest, r.n, packed[part == p].tobytes()) for p in np.unique(part)]
            yield pd.DataFrame(rows, columns=["key", "part", "digest", "n", "windows"])

    def again(frame: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(w, dtype=WINDOW) for w in frame["windows"]]
        owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
        found = np.concatenate(held)
        order = np.lexsort((found["b"], found["a"]))
        found, owner = found[order], owner[order]
        first = np.concatenate([[True], (found["a"][1:] != found["a"][:-1]) | (found["b"][1:] != found["b"][:-1])])
        total = np.add.reduceat(frame["n"].to_numpy(np.int64)[owner], np.flatnonzero(first))
        repeated = total[np.cumsum(first) - 1] > 1
        ats = pd.DataFrame({"i": owner[repeated], "at": found["at"][repeated]}).sort_values(["i", "at"]).groupby("i")["at"].agg(list)
        out = frame.iloc[ats.index][["key", "digest"]].copy()
        out["spans"] = pd.Series([[e for a in at for e in (a, a + length)] for at in ats], index=out.index, dtype=object)
        return out

    rows = contents.mapInPandas(windows, "key bigint, part int, digest bigint, n bigint, windows binary")
    spans = rows.groupBy("key", "part").applyInPandas(again, FOUND)
    return spans.groupBy("key", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, kept = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            words = WORDS.findall(text.as_buffer())
            gone = []
            for a, b in sorted((s["start"], s["end"]) for s in spans or []):
                if gone and a <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], b)
                else:
                    gone.append([a, b])
            counts.append(len(words))
            removed.append([{"start": a, "end": b} for a, b in gone])
            edges = [0, *(e for span in gone for e in span), len(words)]
            kept.append(b" ".join(w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "removed", "kept"])


def remove_repeats(docs: DataFrame, length: int = 35, gram: int = 12, shard_words: int = 100_000, crowd: int = 1024) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) without the words of repeated windows: doc_id, n_words, removed (word spans), kept."""
    if not 1 <= gram <= length:
        raise ValueError("gram must be between 1 and length")
    spark = docs.sparkSession
    texts = docs.select(*_text_key(), text_or_empty().alias("text"))
    places, places_at = stored(anchored_runs(docs, length, gram))
    # Key, start and text of one place of each content: all taken from one row.
    one = [F.first(c).alias(c) for c in ("t1", "t2", "start", "words")]
    contents, contents_at = stored(places.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), *one))
    keys = contents.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).filter("total > 1")
    known, known_at = stored(contents.join(keys.select("key", "kinds"), "key"))
    # The only content of its anchor is repeated as a whole, as its automaton, a chain, would say.
    alone = known.filter("kinds = 1").select("key", "digest", F.array(F.lit(0), F.col("words")).alias("spans"))
    reference = known.filter("kinds > 1")
    sizes = reference.agg(F.sum(F.when(F.col("kinds") <= crowd, F.col("words"))).alias("words"), F.max("kinds").alias("kinds")).first()
    shards = -(-(sizes["words"] or 0) // shard_words) or 1
    shard = F.when(F.col("kinds") > crowd, F.lit(-1)).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards))).cast("int")
    wanted = reference.groupBy("t1", "t2").agg(F.collect_list(F.struct(shard.alias("shard"), "key", "digest", "n", "kinds", "start", "words")).alias("runs"))
    read, read_at = stored(_contents(texts, wanted))
    spans = alone.unionByName(read.filter("shard >= 0").drop("kinds").groupBy("shard").applyInPandas(lambda frame: _shard(frame, length), FOUND))
    if (sizes["kinds"] or 0) > crowd:
        spans = spans.unionByName(_counted(read.filter("shard < 0"), length, 16 * crowd))
    spans, spans_at = stored(spans.filter(F.size("spans") > 0))
    discard(spark, contents_at)
    discard(spark, known_at)
    discard(spark, read_at)

    # Equal texts have equal places: one of each goes on.
    at = F.transform(F.sequence(F.lit(0), F.size("spans") - 1, F.lit(2)), lambda i: F.struct(
        (F.col("start") + F.get("spans", i)).alias("start"), (F.col("start") + F.get("spans", i + 1)).alias("end")))
    hits = places.join(spans, ["key", "digest"]).select("t1", "t2", "key", "digest", "start", "spans").dropDuplicates(["t1", "t2", "start"])
    by_text, _ = stored(hits.select("t1", "t2", at.alias("at")).groupBy("t1", "t2").agg(F.flatten(F.collect_list("at")).alias("spans")))
    discard(spark, places_at)
    discard(spark, spans_at)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_text_key(), text_or_empty().alias("text"))
    joined = rows.join(by_text, ["t1", "t2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_without, "doc_id bigint, n_words bigint, removed array<struct<start: bigint, end: bigint>>, kept string")
