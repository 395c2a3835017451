"""One registered query per operator: it applies the operator to its whole table and derives the digest columns."""

from __future__ import annotations

from gearledger.llm.queries import corpus, search, structure

QUERIES = {**search.QUERIES, **corpus.QUERIES, **structure.QUERIES}
ORACLES = {**search.ORACLES, **corpus.ORACLES, **structure.ORACLES}
