"""Exact top-k search by tiled matrix products.

Candidates are dealt by a hash of their row into shards of about ``shard_rows`` vectors, queries into blocks of about
``block_rows``. Each shard and each block becomes one row that holds its matrix, every (block, shard) tile is one matrix
product with a partial selection of the ``k`` best per query, and the lists of a block are merged in a tree of
``fan_in``. Every task holds one tile or ``fan_in`` lists; the number of tiles grows with the data, their size does not.

Defined results: rows with a null id, a null vector, an empty vector, or a null or non-finite component take no part.
Vectors are only compared with vectors of their length. Every row is a candidate and, where asked, a query of its own: rows that repeat an id
meet each other, and a query leaves out one row only, its own. Equal scores go to the smaller id. Fewer than ``k`` candidates give all of them. Scores beyond a long are held
at its bounds; they are computed exactly, in floating point only where every sum stays below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST = "dim int, block int, node int, queries array<bigint>, own array<bigint>, sizes array<int>, ids array<bigint>, scores array<bigint>"
NAMES = [c.split()[0] for c in LIST.split(", ")]
BLOCK = "dim int, block int, ids array<bigint>, cells array<bigint>"
LONG = 2**63 - 1


def valid_vector(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))
    )


def quantize(vector: Column, scale: int = 256) -> Column:
    """Integer components floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k largest of each row; columns are in id order, so the leftmost of equal scores win."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, dtype=bool)
    limit = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    above, at = scores > limit, scores == limit
    room = k - above.sum(axis=1, dtype=np.int32)[:, None]
    return above | (at & (np.cumsum(at, axis=1, dtype=np.int32) <= room))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer product of two matrices, held to long."""
    bound = int(max(abs(int(a.min())), abs(int(a.max())))) * int(max(abs(int(b.min())), abs(int(b.max())))) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound <= LONG:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -LONG - 1, LONG).astype(np.int64)


def _cells(values, rows: int) -> np.ndarray:
    return np.asarray(values, dtype=np.int64).reshape(rows, -1)


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("id")
    cells = np.concatenate([np.asarray(v, dtype=np.int64) for v in frame["vector"]])
    return pd.DataFrame({
        "dim": frame["dim"].iloc[:1].to_numpy(), "block": frame["block"].iloc[:1].to_numpy(),
        "ids": [frame["id"].to_numpy()], "cells": [cells],
    })


def _lists(dim: int, block: int, node: int, queries: np.ndarray, own: np.ndarray, owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple:
    """The k best of each query out of entries (owner = position of the query)."""
    order = np.lexsort((ids, -scores.astype(np.float64), owner)) if len(scores) and np.abs(scores).max() < 2**53 else np.array(
        sorted(range(len(scores)), key=lambda i: (owner[i], -int(scores[i]), ids[i])), dtype=np.int64)
    owner, ids, scores = owner[order], ids[order], scores[order]
    first = np.searchsorted(owner, owner)
    keep = np.arange(len(owner)) - first < k
    owner, ids, scores = owner[keep], ids[keep], scores[keep]
    return dim, block, node, queries, own, np.bincount(owner, minlength=len(queries)).astype(np.int32), ids, scores


def _tiles(batches: Iterator[pd.DataFrame], k: int, strip: int = 256) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows = []
        for t in frame.itertuples(index=False):
            ids, queries = np.asarray(t.ids, dtype=np.int64), np.asarray(t.queries, dtype=np.int64)
            a, b = _cells(t.query_cells, len(queries)), _cells(t.cells, len(ids))
            found = []
            for at in range(0, len(queries), strip):
                scores = _product(a[at:at + strip], b)
                owner, column = np.nonzero(_best(scores, k))
                found.append((owner + at, ids[column], scores[owner, column]))
            owner, other, scores = (np.concatenate(x) for x in zip(*found, strict=True))
            # A query's score with itself, row by row.
            own = np.concatenate([np.diagonal(_product(a[i:i + 64], a[i:i + 64])) for i in range(0, len(a), 64)])
            rows.append(_lists(t.dim, t.block, t.shard, queries, own, owner, other, scores, k))
        yield pd.DataFrame(rows, columns=NAMES)


def _merge(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    queries, own = (np.asarray(frame[c].iloc[0], dtype=np.int64) for c in ("queries", "own"))
    owner = np.concatenate([np.repeat(np.arange(len(queries)), s) for s in frame["sizes"]])
    ids = np.concatenate([np.asarray(x, dtype=np.int64) for x in frame["ids"]])
    scores = np.concatenate([np.asarray(x, dtype=np.int64) for x in frame["scores"]])
    merged = _lists(frame["dim"].iloc[0], frame["block"].iloc[0], frame["node"].iloc[0], queries, own, owner, ids, scores, k)
    return pd.DataFrame([merged], columns=NAMES)


def _rows(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The lists hold one entry more than asked for: the query's own row leaves, or the last."""
    for frame in batches:
        for t in frame.itertuples(index=False):
            sizes, queries, own = (np.asarray(x, dtype=np.int64) for x in (t.sizes, t.queries, t.own))
            ids, scores, query = np.asarray(t.ids, dtype=np.int64), np.asarray(t.scores, dtype=np.int64), np.repeat(np.arange(len(sizes)), sizes)
            # Rows of the query's id and score can't be told apart in the result, so the first of them stands for its own.
            mine = np.flatnonzero((ids == queries[query]) & (scores == own[query]))
            keep = np.ones(len(ids), dtype=bool)
            keep[mine[np.unique(query[mine], return_index=True)[1]]] = False
            ids, scores, query = ids[keep], scores[keep], query[keep]
            rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
            top = rank <= k
            yield pd.DataFrame({"query_id": queries[query[top]], "rank": rank[top].astype(np.int32), "vec_id": ids[top], "score": scores[top]})


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 256, shard_rows: int = 4096, block_rows: int = 1024, fan_in: int = 16,
) -> DataFrame:
    """The ``k`` best inner products of every query row with all other rows.

    ``is_query`` selects the query rows of ``vectors``. Returns query_id, rank (from 1), vec_id, score.
    """
    rows = vectors.filter(F.col(id_col).isNotNull() & valid_vector(F.col(vector_col))).select(
        F.col(id_col).cast("bigint").alias("id"), F.size(vector_col).alias("dim"), quantize(F.col(vector_col), scale).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(is_query, F.lit(False))).alias("q")).first()
    shards, blocks = -(-size["n"] // shard_rows) or 1, -(-size["q"] // block_rows) or 1

    def packed(frame: DataFrame, parts: int) -> DataFrame:
        # By id and row: a repeated id, or a repeated row, doesn't crowd one block.
        dealt = frame.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(parts)).cast("int"))
        return dealt.groupBy("dim", "block").applyInPandas(_pack, BLOCK)

    held = packed(rows, shards).withColumnRenamed("block", "shard")
    asked = packed(rows.filter("asks"), blocks).select(
        "dim", "block", F.col("ids").alias("queries"), F.col("cells").alias("query_cells"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    # One row is a whole matrix, so this equi-join moves few rows; each joined row is one tile. The optimizer takes the queries for the few that they
    # are before they are dealt to all shards and would collect all of these in the driver, so it is told to move them.
    tiles = asked.join(held.hint("merge"), ["dim", "shard"])
    lists = tiles.mapInPandas(lambda batches: _tiles(batches, k + 1), LIST)
    while True:
        shards = -(-shards // fan_in)
        lists = lists.withColumn("node", F.floor(F.col("node") / fan_in).cast("int"))
        lists = lists.groupBy("dim", "block", "node").applyInPandas(lambda frame: _merge(frame, k + 1), LIST)
        if shards == 1:
            return lists.mapInPandas(lambda batches: _rows(batches, k), "query_id bigint, rank int, vec_id bigint, score bigint")
