"""Toxicity scores by FTRL-proximal logistic regression.

Features are hashed word n-grams (single words and pairs) and skip-grams (pairs with one or two words between), and beside these the runs of
four characters within words, so inflected forms of a word share weights; each counts once per text. FTRL-proximal learns one weight per coordinate with its own rate and L1 sparsity; what is left after training is a
compact list of weights that goes to the tasks.

The classifier is fitted on a bounded sample: of each class the ``sample_rows`` labelled rows with the smallest hash of their id.
Features are made in parallel; the learner itself is sequential, so the sample, not the corpus, passes one task. As the sample is
balanced and the labels are not, the class weight restores the share of the labelled rows, counted over all of them.

Defined results: an empty or null text has the score of the intercept alone. If one class has no rows, all scores are the share of label 1
among the labelled rows (0 without any). Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearledger.llm.common import cut_lineage, sampled

MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


@dataclass(frozen=True)
class Model:
    coordinates: np.ndarray  # sorted, int64
    weights: np.ndarray
    intercept: float
    bits: int
    skips: int
    inner: int


def word_characters() -> np.ndarray:
    """Whether each code point belongs to a word (a letter, digit or underscore)."""
    return np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), dtype=bool, count=0x110000)


def features(text: str | None, bits: int, skips: int, inner: int, letters: np.ndarray) -> np.ndarray:
    """Hashed coordinates of a text, repeats included: words, pairs at distance 1 to ``skips`` + 1, and ``inner`` characters in a row within words."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    inside = letters[codes]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(MULTIPLIERS[0])
    mixed ^= mixed >> np.uint64(31)
    # A word's hash is a polynomial of its characters, read off running sums (modulo 2**64, where an odd base has an inverse).
    up, down = np.full(len(codes), BASE), np.full(len(codes), INVERSE)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed * up, dtype=np.uint64)])
    word = (sums[ends] - sums[starts]) * down[starts]
    word ^= word >> np.uint64(29)
    out = [word * np.uint64(MULTIPLIERS[1])]
    for gap in range(1, skips + 2):
        if len(word) > gap:
            pair = (word[:-gap] * np.uint64(MULTIPLIERS[1]) ^ (word[gap:] + np.uint64(gap)) * np.uint64(MULTIPLIERS[2])) * np.uint64(MULTIPLIERS[3])
            out.append(pair)
    if inner and len(codes) >= inner:
        size = len(codes) - inner + 1
        whole, gram = np.ones(size, dtype=bool), np.zeros(size, dtype=np.uint64)
        for i in range(inner):
            whole &= inside[i: i + size]
            gram = (gram ^ mixed[i: i + size]) * np.uint64(MULTIPLIERS[2])
            gram ^= gram >> np.uint64(31)
        out.append(gram[whole] * np.uint64(MULTIPLIERS[3]))
    return (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64)


def train(rows: list[tuple[np.ndarray, int]], bits: int, share: float, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple:
    """FTRL-proximal over (coordinates, label) rows in the given order; ``share`` is the wanted mean label."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    mean = sum(y for _, y in rows) / len(rows)
    importance = {1: share / mean, 0: (1 - share) / (1 - mean)}

    def weight(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for at, y in rows:
            w = weight(z[at], n[at])
            bias = -bias_z / ((beta + bias_n ** 0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = (p - y) * importance[y]
            seen = n[at]
            z[at] += g - (np.sqrt(seen + g * g) - np.sqrt(seen)) / alpha * w
            n[at] = seen + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n ** 0.5) / alpha * bias
            bias_n += g * g
    w = weight(z, n)
    kept = np.flatnonzero(w)
    return kept.astype(np.int64), w[kept], float(-bias_z / ((beta + bias_n ** 0.5) / alpha))


def fit(
    labelled: DataFrame, sample_rows: int = 4000, bits: int = 20, skips: int = 2, inner: int = 4, alpha: float = 0.5, beta: float = 1.0,
    l1: float = 3.0, l2: float = 0.5, epochs: int = 3,
) -> Model:
    """Learn from ``labelled`` (doc_id, text, toxic); leave held-out rows away before."""
    rows = labelled.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        p = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log(p / (1 - p))), bits, skips, inner)
    # At most 2 * sample_rows short rows. The ids alone reach the scan of the texts, below the join that brought the labels.
    chosen = cut_lineage(sampled(rows, "toxic", sample_rows, 2))
    sample = rows.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    sample = sample.join(F.broadcast(chosen), ["doc_id", "toxic"], "left_semi").select("doc_id", "toxic", "text")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = word_characters()
        for frame in batches:
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "toxic": frame["toxic"].astype("int32"),
                "at": [np.unique(features(t, bits, skips, inner, letters)).astype(np.int32).tobytes() for t in frame["text"]],
            })

    made = cut_lineage(sample.mapInPandas(featured, "doc_id bigint, toxic int, at binary"))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort([hash((int(d) * 2654435761) % 2**32) for d in frame["doc_id"]], kind="stable")
        rows = [(np.frombuffer(frame["at"].iloc[i], dtype=np.int32).astype(np.int64), int(frame["toxic"].iloc[i])) for i in order]
        at, w, bias = train(rows, bits, share, alpha, beta, l1, l2, epochs)
        return pd.DataFrame({"at": [*at, -1], "w": [*w, bias]})

    weights = made.groupBy(F.lit(0).alias("all")).applyInPandas(lambda key, frame: learn(frame.sort_values("doc_id")), "at bigint, w double")
    # At most 2**bits rows; L1 leaves a small part of them.
    out = cut_lineage(weights).toPandas().sort_values("at")
    rest = out[out["at"] >= 0]
    return Model(rest["at"].to_numpy(np.int64), rest["w"].to_numpy(np.float64), float(out.loc[out["at"] < 0, "w"].iloc[0]), bits, skips, inner)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, score (probability of label 1) and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values, as the tasks need no copy of the library

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, letters = Model(**shared.value), word_characters()
        dense = np.zeros(1 << m.bits)
        dense[m.coordinates] = m.weights

        def raw_score(text: str | None) -> float:
            at = features(text, m.bits, m.skips, m.inner, letters)
            return dense[np.unique(at[dense[at] != 0])].sum() + m.intercept

        for frame in batches:
            raw = np.array([raw_score(t) for t in frame["text"]], dtype=np.float64)
            p = 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.mapInPandas(scored, "doc_id bigint, score double, predicted int")
