"""Whitening of embeddings along their leading principal components, by Chebyshev-filtered subspace iteration.

Vectors are quantized once and written as blocks, one row per block of about ``block_cells`` integers. The covariance
V = (1/n) Xc' Xc of the centred vectors is never formed: a pass multiplies it with a thin matrix Q, each task sending
Xc' (Xc Q) of its blocks, and the driver holds only matrices of (dimension x subspace). On these products run

* a few Lanczos steps, which bound the spectrum from below,
* the Chebyshev recurrence, which damps what lies between that bound and the least Ritz value of the subspace,
* QR and Rayleigh-Ritz, repeated until every wanted pair is certified by its residual ||V q - e q||.

The subspace has ``components + guard`` columns; where that reaches the dimension, one Rayleigh-Ritz step is exact.
Centring is exact: sums are integers, and a centred component is (n * y - sum) / n with an integer numerator.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry take no part; of vectors of several
lengths those of the most frequent length do (ties: the smallest). A null id is an id like any other, and repeated rows
count as often as they occur. Quantized entries are held within 2**52. Components without variance (fewer distinct vectors than components, or
fewer dimensions) are not returned, so a table of equal vectors, of one vector or of none gives no rows. Components of
equal eigenvalues are some orthonormal basis. A deviation beyond a long is null. Every extra column is ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearledger.llm.common import stored
from gearledger.llm.topk import valid_vector

HELD = 2**52
# Ids enter Python as text: a column with nulls would become floating point there.
BLOCK = "ids array<string>, width int, cells binary"
RESULT = "vec_id string, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@dataclass
class Axes:
    """Leading components of a fit list: unit vectors as columns, eigenvalues falling."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int = 0
    identity_error: float = field(default=0.0)


def _blocks(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int, rows_per_block: int) -> DataFrame:
    """One row per block: ids and quantized cells, each block in the narrowest integer type that holds it."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), rows_per_block):
                part = frame.iloc[at:at + rows_per_block]
                cells = np.floor(np.stack([np.asarray(v, dtype=np.float64) for v in part["vector"]]) * scale)
                cells = np.clip(cells, -HELD, HELD).astype(np.int64)
                most = int(np.abs(cells).max())
                width = 2 if most < 2**15 else 4 if most < 2**31 else 8
                yield pd.DataFrame({"ids": [list(part["id"])], "width": np.array([width], dtype=np.int32), "cells": [cells.astype(f"<i{width}").tobytes()]})

    rows = vectors.filter(valid_vector(F.col(vector_col)) & (F.size(vector_col) == dim))
    rows = rows.select(F.col(id_col).cast("bigint").cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInPandas(made, BLOCK)


def _cells(row, dim: int) -> np.ndarray:
    return np.frombuffer(row.cells, dtype=f"<i{row.width}").astype(np.int64).reshape(-1, dim)


def _centred(cells: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * y - sum per entry (integers) and the centred vectors."""
    bound = n * max(1, int(np.abs(cells).max(initial=0))) + max(map(abs, sums))
    if bound < 2**62:
        scaled = cells * n - np.array(sums, dtype=np.int64)
        return scaled, scaled / n
    scaled = cells.astype(object) * n - np.array(sums, dtype=object)
    return scaled, (scaled / n).astype(np.float64)


class Passes:
    """Products over the written blocks. Every pass is one Spark job; partial sums meet in groups before the driver adds them."""

    def __init__(self, blocks: DataFrame, dim: int, parts: int) -> None:
        self.blocks, self.dim, self.parts, self.count = blocks, dim, parts, 0
        self.n, self.sums, self.squares = 0, [], []

    def total(self, of_block: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """Sum over all blocks of a vector of ``size`` doubles made of each block's cells."""
        dim, groups = self.dim, max(1, int(self.parts**0.5)) if self.parts > 64 else 0

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = np.zeros(size)
            for frame in batches:
                for row in frame.itertuples(index=False):
                    held += of_block(_cells(row, dim)).ravel()
            yield pd.DataFrame({"held": [held.tobytes()]})

        def added(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"held": [np.sum([np.frombuffer(h) for h in frame["held"]], axis=0).tobytes()]})

        sums = self.blocks.select("width", "cells").mapInPandas(partial, "held binary")
        if groups:
            sums = sums.groupBy(F.pmod(F.spark_partition_id(), F.lit(groups)).alias("node")).applyInPandas(added, "held binary")
        self.count += 1
        return np.sum([np.zeros(size), *(np.frombuffer(r["held"]) for r in sums.collect())], axis=0)

    def measure(self) -> None:
        """Exact count, sums and sums of squares, the last two as integers in decimal text per dimension."""
        dim = self.dim

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                for row in frame.itertuples(index=False):
                    cells = _cells(row, dim)
                    wide = cells if row.width == 2 else cells.astype(object)
                    yield pd.DataFrame({
                        "at": np.arange(dim, dtype=np.int32), "n": np.full(dim, len(cells)),
                        "total": [str(v) for v in wide.sum(axis=0)], "square": [str(v) for v in (wide * wide).sum(axis=0)],
                    })

        rows = self.blocks.select("width", "cells").mapInPandas(partial, "at int, n bigint, total string, square string")
        wide = "decimal(38,0)"
        found = rows.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast(wide)).alias("t"), F.sum(F.col("square").cast(wide)).alias("s"))
        found = sorted(found.collect(), key=lambda r: r["at"])
        self.n = found[0]["n"] if found else 0
        self.sums, self.squares = [int(r["t"]) for r in found], [int(r["s"]) for r in found]

    def trace(self) -> float:
        return sum(self.n * s - t * t for s, t in zip(self.squares, self.sums, strict=True)) / (self.n * self.n)

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q by one pass over the data."""
        n, sums = self.n, self.sums

        def product(cells: np.ndarray) -> np.ndarray:
            centred = _centred(cells, n, sums)[1]
            return centred.T @ (centred @ q) / n

        return self.total(product, q.size).reshape(q.shape)


def _least(passes: Passes, steps: int, pick: np.random.Generator) -> float:
    """A lower bound of the spectrum by Lanczos: the least Ritz value less its residual."""
    basis, alphas, betas = [], [], []
    v = pick.standard_normal(passes.dim)
    v /= np.linalg.norm(v)
    for _ in range(min(steps, passes.dim)):
        basis.append(v)
        w = passes.times(v[:, None])[:, 0]
        alphas.append(float(v @ w))
        for _ in range(2):
            for b in basis:
                w = w - (b @ w) * b
        beta = float(np.linalg.norm(w))
        if beta <= 1e-12 * max(map(abs, alphas)):
            return 0.0
        betas.append(beta)
        v = w / beta
    values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1))
    return max(0.0, float(values[0] - abs(vectors[-1, 0]) * betas[-1]))


def _ritz(passes: Passes, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), Ritz vectors, their products with V, and the residuals of an orthonormal basis."""
    w = passes.times(q)
    h = q.T @ w
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    q, w = q @ turn, w @ turn
    return values, q, w, np.linalg.norm(w - q * values, axis=0)


def _filtered(passes: Passes, q: np.ndarray, w: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of ``degree`` of V that is small on [low, cut], scaled to 1 at ``top``, times q; w is V q."""
    centre, half = (low + cut) / 2, (cut - low) / 2
    sigma = first = half / (top - centre)
    before, now = q, (w - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        later = 1 / (2 / first - sigma)
        before, now = now, (passes.times(now) - centre * now) * (2 * later / half) - before * (sigma * later)
        sigma = later
    return now


def principal_axes(passes: Passes, components: int, guard: int = 40, lanczos: int = 8, tolerance: float = 1e-12, max_rounds: int = 60, seed: int = 0) -> Axes:
    """The leading ``components`` eigenpairs of V. A pair is certified when its residual is at most ``tolerance`` times the largest eigenvalue."""
    dim, pick = passes.dim, np.random.default_rng(seed)
    wide = min(dim, components + guard)
    q = np.eye(dim) if wide == dim else np.linalg.qr(pick.standard_normal((dim, wide)))[0]
    k = min(components, dim)
    values, q, w, residuals = _ritz(passes, q)
    low = _least(passes, lanczos, pick) if wide < dim else 0.0
    best = np.inf
    for _ in range(max_rounds):
        worst = residuals[:k].max() / max(values[0], 1e-300)
        # Go on below the tolerance while a round still gains: close eigenvalues turn a residual into a larger angle.
        if wide == dim or values[0] <= 0 or (worst <= tolerance and worst > best / 4):
            break
        best = min(best, worst)
        cut = max(values[-1], 1e-15 * values[0])
        floor = low if low < cut else 0.0
        edge = (values[0] - (floor + cut) / 2) / ((cut - floor) / 2)
        # Beyond a growth of 1e8 the leading vector would swallow the digits of the others.
        degree = int(np.clip(np.log(2e8) / np.arccosh(max(edge, 1 + 1e-9)), 2, 12))
        q = np.linalg.qr(_filtered(passes, q, w, floor, cut, values[0], degree))[0]
        values, q, w, residuals = _ritz(passes, q)
    else:
        raise RuntimeError(f"components are not certified after {max_rounds} rounds: residual {worst:.2e}")
    kept = values[:k] > 1e-12 * values.sum()
    return Axes(passes.n, passes.sums, passes.trace(), values[:k][kept], q[:, :k][:, kept], residuals[:k][kept], passes.count)


def _projected(cells: np.ndarray, axes: Axes) -> tuple[np.ndarray, np.ndarray]:
    scaled, centred = _centred(cells, axes.n, axes.sums)
    return scaled, centred @ axes.vectors / np.sqrt(axes.values)


def _deviation(scaled: np.ndarray) -> list[int | None]:
    if scaled.dtype != object and float(np.abs(scaled.astype(np.float64)).max(initial=0)) ** 2 * scaled.shape[1] < 2**62:
        return (scaled * scaled).sum(axis=1).tolist()
    sums = (scaled.astype(object) ** 2).sum(axis=1)
    return [int(s) if s < 2**63 else None for s in sums]


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vec_id", F.col("vec_id").cast("bigint"))


def whiten(
    vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024,
    block_cells: int = 1 << 18, tolerance: float = 1e-12,
) -> DataFrame:
    """Every vector on the leading components, scaled to unit variance: one row per vector and component.

    vec_id, component (from 1, by falling eigenvalue), n, deviation (sum over dimensions of (n * y - sum)**2, exact), whitened, explained
    (share of the total variance), identity_error (largest entry of the whitened vectors' covariance less the identity, one value).
    A shift of all entries changes none of these. The fit runs when this is called.
    """
    spark = vectors.sparkSession
    sizes = vectors.filter(valid_vector(F.col(vector_col))).groupBy(F.size(vector_col).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), "dim").first()
    if most is None:
        return _named(spark.createDataFrame([], RESULT))
    dim, rows_per_block = most["dim"], max(1, block_cells // most["dim"])
    parts = max(1, min(-(-most["n"] // rows_per_block), 4 * spark.sparkContext.defaultParallelism))
    # Blocks are dealt out, not rows, so equal rows can't crowd one task. They stay: the returned frame reads them.
    made = _blocks(vectors, id_col, vector_col, dim, scale, rows_per_block).withColumn("block", F.monotonically_increasing_id())
    blocks = stored(made.repartition(parts, "block"))[0].drop("block")
    passes = Passes(blocks, dim, parts)
    passes.measure()
    if passes.trace() <= 0:
        return _named(spark.createDataFrame([], RESULT))
    axes = principal_axes(passes, components, tolerance=tolerance)
    k = len(axes.values)

    def moments(cells: np.ndarray) -> np.ndarray:
        white = _projected(cells, axes)[1]
        return np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])

    sums = passes.total(moments, k + k * k) / axes.n
    covariance = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])
    axes.identity_error = float(np.abs(covariance - np.eye(k)).max())

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                scaled, white = _projected(_cells(row, dim), axes)
                rows = len(white)
                yield pd.DataFrame({
                    "vec_id": np.repeat(np.array(row.ids, dtype=object), k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows), "n": np.full(rows * k, axes.n),
                    "deviation": pd.array(_deviation(scaled), dtype="Int64").repeat(k), "whitened": white.ravel(),
                    "explained": np.tile(axes.values / axes.trace, rows), "identity_error": np.full(rows * k, axes.identity_error),
                })

    return _named(blocks.mapInPandas(written, RESULT))
