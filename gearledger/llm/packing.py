"""Bounded-space online packing of token sequences.

Each partition is packed in one pass: a fixed number of windows stays open, an arriving piece goes to the fullest
window that still has room for it (best fit), and when none has, the fullest window is topped up with the head of the
piece and emitted full. Memory is ``windows`` sequences, whatever the partition holds. At the end of a partition its
open windows are run together, so it leaves less than one sequence; these leftovers are merged over partitions in a tree
of ``fan_in`` until one is left, which is cut into powers of two, lengths that need no padding.

Defined results: a null text is an empty one, an empty document is its end id alone, a document longer than a sequence
is cut, each id lies in exactly one piece. Repeated ids are packed row by row. An empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearledger.llm.common import cut_lineage, text_or_empty

PIECE = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, sequence_id bigint, offset bigint, node bigint, full boolean"
NAMES = [c.split()[0] for c in PIECE.split(", ")]
SPECIAL = "<|endoftext|>"


def byte_bpe(json_path: str, ranks_path: str | None = None) -> Callable[[list[str]], list[np.ndarray]]:
    """Encoder of texts to ids of a byte-level BPE, without added special tokens.

    With ``ranks_path``, the same vocabulary as ranks, texts without the special token's string go through the
    faster of the two public libraries, which gives the same ids.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    slow = lambda text: whole.encode(text, add_special_tokens=False).ids
    fast = None
    if ranks_path:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(slow(t) if fast is None or SPECIAL in t else fast(t), dtype="<u4") for t in texts]

    return encode


def public_byte_bpe() -> Callable[[list[str]], list[np.ndarray]]:
    """The installed public byte-level BPE of 50 257 ids."""
    import public_tokenizers

    return byte_bpe(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


class Packer:
    """The open windows of one partition or merge. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, length: int, windows: int) -> None:
        self.length, self.windows = length, windows
        self.open: list[tuple[int, list]] = []  # (used, pieces)

    def add(self, piece: tuple) -> Iterator[list]:
        """Place one piece and yield the sequences that became full."""
        doc, start, total, ids = piece
        while len(ids):
            if len(ids) >= self.length:
                yield [(doc, start, total, ids[: self.length])]
                start, ids = start + self.length, ids[self.length:]
                continue
            fits = [i for i, (used, _) in enumerate(self.open) if used + len(ids) <= self.length]
            if fits:
                at = max(fits, key=lambda i: self.open[i][0])
                used, pieces = self.open[at]
                pieces.append((doc, start, total, ids))
                if used + len(ids) == self.length:
                    del self.open[at]
                    yield pieces
                else:
                    self.open[at] = (used + len(ids), pieces)
                return
            if len(self.open) < self.windows:
                self.open.append((len(ids), [(doc, start, total, ids)]))
                return
            at = max(range(len(self.open)), key=lambda i: self.open[i][0])
            used, pieces = self.open.pop(at)
            room = self.length - used
            yield [*pieces, (doc, start, total, ids[:room])]
            start, ids = start + room, ids[room:]

    def close(self) -> Iterator[list]:
        """Run the open windows together: full sequences, then at most one shorter one."""
        rest = Packer(self.length, 1)
        for _, pieces in sorted(self.open, key=lambda w: -w[0]):
            for piece in pieces:
                yield from rest.add(piece)
        self.open = []
        yield from (pieces for _, pieces in rest.open)


def _out(sequences: Iterable[tuple[int, list]], length: int, node: int) -> list[tuple]:
    rows = []
    for sequence, pieces in sequences:
        full = sum(len(p[3]) for p in pieces) == length
        offset = 0
        for doc, start, total, ids in pieces:
            rows.append((doc, start, len(ids), total, ids.tobytes(), sequence, offset, node, full))
            offset += len(ids)
    return rows


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=NAMES)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def pack(
    docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]], end_id: int = 1, length: int = 2048,
    windows: int = 32, fan_in: int = 64, batch: int = 64,
) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text).

    ``encoder`` makes the encoder inside a task. Returns one row per piece: doc_id, start, length, doc_tokens, ids
    (little-endian unsigned 32 bit), sequence_id and offset. The first pass is written once and read twice, for its full
    sequences and for the leftovers, so no text is encoded again and a lost executor repeats only its own partitions.
    """

    def first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, packer, number = encoder(), Packer(length, windows), 0
        for frame in batches:
            doc_ids = [None if pd.isna(d) else int(d) for d in frame["doc_id"]]
            texts = frame["text"].tolist()
            for at in range(0, len(texts), batch):
                done = []
                for doc, ids in zip(doc_ids[at:at + batch], encode(texts[at:at + batch]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for pieces in packer.add((doc, 0, len(ids), ids)):
                        done.append(((part << 33) + number, pieces))
                        number += 1
                if done:
                    yield _frame(_out(done, length, part))
        rest = [((part << 33) + number + i, pieces) for i, pieces in enumerate(packer.close())]
        if rest:
            yield _frame(_out(rest, length, part))

    def merge(level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def merged(frame: pd.DataFrame) -> pd.DataFrame:
            node = int(frame["node"].iloc[0])
            packer = Packer(length, 1)
            sequences: list[list] = []
            frame = frame.sort_values(["sequence_id", "offset"])
            for doc, start, total, ids in zip(frame["doc_id"], frame["start"], frame["doc_tokens"], frame["ids"], strict=True):
                doc = None if pd.isna(doc) else int(doc)
                sequences += packer.add((doc, int(start), int(total), np.frombuffer(ids, dtype="<u4")))
            rest = list(packer.close())
            if last:
                rest = [cut for pieces in rest for cut in _powers(pieces)]
            base = -((level << 56) + (node << 32))
            return _frame(_out([(base - 1 - i, pieces) for i, pieces in enumerate(sequences + rest)], length, node))

        return merged

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    done = cut_lineage(texts.mapInPandas(first_pass, PIECE))
    parts = (done.agg(F.max("node")).first()[0] or 0) + 1
    result, level = done.filter("full"), 0
    rest = done.filter("not full")
    while True:
        level, parts = level + 1, -(-parts // fan_in)
        step = rest.withColumn("node", F.floor(F.col("node") / fan_in)).groupBy("node").applyInPandas(merge(level, parts == 1), PIECE)
        step = cut_lineage(step)
        if parts == 1:
            return result.unionByName(step).drop("node", "full")
        result, rest = result.unionByName(step.filter("full")), step.filter("not full")


def _powers(pieces: list) -> list[list]:
    """Cut one sequence into sequences whose lengths are powers of two."""
    left = sum(len(p[3]) for p in pieces)
    out: list[list] = []
    queue = list(pieces)
    while left:
        want, taken = 1 << (left.bit_length() - 1), []
        left -= want
        while want:
            doc, start, total, ids = queue.pop(0)
            taken.append((doc, start, total, ids[:want]))
            if len(ids) > want:
                queue.insert(0, (doc, start + want, total, ids[want:]))
            want -= len(taken[-1][3])
        out.append(taken)
    return out
