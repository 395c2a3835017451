"""op1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearledger.llm.common import table
from gearledger.llm.topk import top_k


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES = {"op1_exact_topk": op1_exact_topk}

ORACLES = {
    "op1_exact_topk": """
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.row AS row, q.vec_id AS query_id, o.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.c, o.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v o ON len(q.c) = len(o.c) AND q.row <> o.row
    WHERE q.vec_id % 50 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
