"""Token counts by count-only Viterbi.

An Aho-Corasick automaton over a unigram vocabulary enumerates all pieces that end at each character; dynamic programming carries the
best score and its piece count, never the segmentation. White space is normalised as the vocabulary expects it: runs become one
word mark, which also starts the text. As no piece has a word mark behind its first character, a best path never crosses the start of
a word, so texts are counted word by word and equal words once per task (within a bounded cache).

Tie rules of the reference tokenizer: scores are added from the left, pieces are tried by ascending start, and only a strictly better
score replaces an earlier one. A character that no piece of its own covers may be an unknown piece, ``unknown_penalty`` below the lowest
score of the vocabulary; unknown pieces in a row count once.

Defined results: a null or empty text, or one of white space only, has 0 tokens. Repeated rows are counted row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a public model, without control and byte pieces, pieces with an inner word mark, and the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return [(p, s) for p, s in pieces if MARK not in p[1:]]


class Counter:
    """Counts the pieces of words under one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], unknown_penalty: float = 10.0, cache: int = 500_000) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.unknown = (min(s for _, s in pieces) if pieces else 0.0) - unknown_penalty
        self.cache, self.known = cache, {}

    def word(self, word: str) -> int:
        """Pieces of the best segmentation of one word with its mark."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if len(self.automaton):
            for last, (length, score) in self.automaton.iter(word):
                ends[last + 1].append((length, score))
        # best[i]: (score, count, ends in an unknown piece) of the first i characters.
        best: list[tuple[float, int, bool]] = [(0.0, 0, False)] * (n + 1)
        for at in range(1, n + 1):
            top = None
            single = False
            for length, score in sorted(ends[at], reverse=True):
                before = best[at - length]
                single |= length == 1
                if top is None or before[0] + score > top[0]:
                    top = (before[0] + score, before[1] + 1, False)
            if not single:
                before = best[at - 1]
                if top is None or before[0] + self.unknown > top[0]:
                    top = (before[0] + self.unknown, before[1] + (not before[2]), True)
            best[at] = top
        return best[n][1]

    def text(self, text: str | None) -> int:
        total = 0
        for word in (text or "").replace(MARK, " ").split():
            count = self.known.get(word)
            if count is None:
                if len(self.known) >= self.cache:
                    self.known.clear()
                count = self.word(MARK + word)
                self.known[word] = count
            total += count
        return total


def token_counts(docs: DataFrame, vocabulary_of: Callable[[], list[tuple[str, float]]], unknown_penalty: float = 10.0) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of ``docs`` (doc_id, text). ``vocabulary_of`` gives (piece, score) inside a task."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(vocabulary_of(), unknown_penalty)
        for frame in batches:
            texts = [t or "" for t in frame["text"]]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].astype("Int64"), "n_words": [len(t.replace(MARK, " ").split()) for t in texts],
                "n_tokens": [counter.text(t) for t in texts],
            })

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.mapInPandas(counted, "doc_id bigint, n_words bigint, n_tokens bigint")
