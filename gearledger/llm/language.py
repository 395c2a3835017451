"""Language identification by multilingual mixture inference.

A model holds, per language, smoothed likelihoods of hashed character n-grams (of words with a space on either side), and a
background component that spreads its mass evenly, for text of no learned language. A document is a mixture: its n-grams come
from languages in unknown proportions, which expectation-maximisation estimates. The language set is selected by penalised
likelihood: languages are added in order of their proportion as long as twice the gain in log-likelihood exceeds the
penalty per language times the log of the number of n-grams.

The likelihoods are fitted on a bounded sample: of each language the ``sample_rows`` labelled rows with the smallest hash of
their id. Counting is a Spark aggregate over (language, n-gram) with map-side sums. Every label value is learned; the model that is
sent to the tasks holds only the n-grams that a language has in its sample (eight bytes each), and one number per language for all others.

Defined results: a null text, a text without a letter, and any text when nothing was learned, is ``und`` with score 0. Rows
without a language label or id teach nothing. Equal likelihoods go to the language first in order of code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearledger.llm.common import cut_lineage, sampled


@dataclass(frozen=True)
class Model:
    languages: list[str]
    starts: np.ndarray  # of each n-gram in the two below, and their end
    language: np.ndarray  # number of the language, int32
    likelihood: np.ndarray  # of the n-gram in that language, float32
    unseen: np.ndarray  # likelihood of any other n-gram, by language
    bits: int
    n: int
    penalty: float
    rounds: int

    def table(self, grams: np.ndarray) -> np.ndarray:
        """Likelihoods of n-grams (rows) by language."""
        size = self.starts[grams + 1] - self.starts[grams]
        row = np.repeat(np.arange(len(grams)), size)
        at = np.arange(len(row)) + np.repeat(self.starts[grams] - (np.cumsum(size) - size), size)
        out = np.tile(self.unseen, (len(grams), 1))
        out[row, self.language[at]] = self.likelihood[at]
        return out


def ngrams(text: str, n: int, bits: int) -> np.ndarray:
    """Hashed n-grams of the lower-cased letters of a text; everything else counts as one space."""
    import re

    letters = re.sub(r"[\W\d_]+", " ", text.lower())
    codes = np.frombuffer((" " + letters + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(codes) < n:
        return np.zeros(0, dtype=np.int64)
    mixed = np.zeros(len(codes) - n + 1, dtype=np.uint64)
    for i in range(n):
        mixed = (mixed ^ codes[i: len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def fit(
    docs: DataFrame, sample_rows: int = 2000, n: int = 3, bits: int = 16, smoothing: float = 0.5,
    penalty: float = 4.0, rounds: int = 8,
) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that have a language; leave held-out rows away before."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # The last sampled row of each language tells which rows are in the sample, so the texts that are not stay where they lie.
    order = F.struct(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("hash"), "doc_id")
    last = sampled(labelled, "lang", sample_rows).groupBy("lang").agg(F.max(order).alias("last"))
    sample = labelled.join(F.broadcast(last), "lang").filter(order <= F.col("last")).select("lang", "text")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for lang, texts in frame.groupby("lang")["text"]:
                grams, count = np.unique(np.concatenate([ngrams(t, n, bits) for t in texts]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams, "count": count})

    counts = sample.mapInPandas(counted, "lang string, gram bigint, count bigint").groupBy("lang", "gram").agg(F.sum("count").alias("count"))
    counts = cut_lineage(counts)

    def gathered(frame: pd.DataFrame) -> pd.DataFrame:
        """One row per language, of at most 2**bits n-grams."""
        arrays = frame["gram"].to_numpy(np.int32), frame["count"].to_numpy(np.int64)
        return pd.DataFrame([(frame["lang"].iloc[0], *(a.tobytes() for a in arrays))], columns=["lang", "grams", "counts"])

    rows = counts.groupBy("lang").applyInPandas(gathered, "lang string, grams binary, counts binary").collect()
    rows = sorted(rows, key=lambda r: r["lang"].encode())
    grams = [np.frombuffer(r["grams"], dtype=np.int32) for r in rows]
    seen = [np.frombuffer(r["counts"], dtype=np.int64) for r in rows]
    totals = np.array([c.sum() + smoothing * (1 << bits) for c in seen], dtype=np.float64)
    number = np.repeat(np.arange(len(rows), dtype=np.int32), [len(g) for g in grams])
    likely = np.concatenate([*(((c + smoothing) / t).astype(np.float32) for c, t in zip(seen, totals, strict=True)), np.zeros(0, dtype=np.float32)])
    grams = np.concatenate([*grams, np.zeros(0, dtype=np.int32)])
    by_gram = np.argsort(grams, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(grams, minlength=1 << bits))])
    unseen = (smoothing / totals).astype(np.float32)
    return Model([r["lang"] for r in rows], starts, number[by_gram], likely[by_gram], unseen, bits, n, penalty, rounds)


def _mixture(likelihood: np.ndarray, count: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``likelihood`` in a text, and its log-likelihood under them."""
    share = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    total = count.sum()
    for _ in range(rounds):
        joint = likelihood * share
        share = (count / joint.sum(axis=1)) @ joint / total
    return share, float(count @ np.log(likelihood @ share))


def infer(model: Model, text: str | None) -> tuple[str, float, dict[str, float]]:
    """Main language, its share of the text, and the share of each selected language."""
    if text is None or not model.languages or not any(c.isalpha() for c in text):
        return "und", 0.0, {}
    grams = ngrams(text, model.n, model.bits)
    if not len(grams):
        return "und", 0.0, {}
    grams, count = np.unique(grams, return_counts=True)
    table = np.empty((len(grams), len(model.languages) + 1))
    table[:, :-1] = model.table(grams)
    # The background spreads its mass evenly; n-grams that no language has count more for it.
    table[:, -1] = 1.0 / (1 << model.bits)
    share, best = _mixture(table, count, model.rounds)
    order = np.argsort(-share[:-1], kind="stable")
    need = model.penalty * np.log(count.sum() + 1)
    chosen, likely = None, 0.0
    for size in range(1, len(order) + 1):
        columns = [*order[:size], len(model.languages)]
        if size > 1 and 2 * (best - likely) <= need:
            break  # even all languages together gain too little
        tried, gained = _mixture(table[:, columns], count, model.rounds)
        if chosen is not None and 2 * (gained - likely) <= need:
            break
        chosen, likely = dict(zip((int(c) for c in columns), tried, strict=True)), gained
    found = {model.languages[c]: float(s) for c, s in chosen.items() if c < len(model.languages)}
    main = max(sorted(found, key=lambda s: s.encode()), key=found.get)
    return main, min(1.0, max(0.0, found[main])), found


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score (share of that language in the text) and languages (share of each selected one).

    Columns of ``docs`` that have one of these names are replaced.
    """
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values, as the tasks need no copy of the library
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("languages", MapType(StringType(), DoubleType()))]
    docs = docs.drop(*[f.name for f in added])

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Model(**shared.value)
        for batch in batches:
            found = [infer(learned, t) for t in batch.column("text").to_pylist()]
            columns = [
                pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "lang_pred", "score", "languages"])

    return docs.mapInArrow(predicted, StructType([*docs.schema.fields, *added]))
