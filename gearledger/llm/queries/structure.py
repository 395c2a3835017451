"""Queries over conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gearledger.llm import conversations, whitening
from gearledger.llm.common import table


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of all conversations after planted damage."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.audited(rows, conversations.damaged(rows)).drop("rows")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their eight leading components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_conversations": op11_conversations, "op13_whitening": op13_whitening}

ORACLES = {
    "op11_conversations": r"""
WITH RECURSIVE bits AS (
    SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text
    FROM conversations
), kinds AS (
    SELECT *, xor(list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(name) + 1), lambda i: list_transform(range(0, 8), lambda b: CAST((ord(name[i]) >> b) & 1 AS BIGINT))))),
        lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384::BIGINT)), 4294967295::BIGINT) % 20 AS kind
    FROM bits
), rows AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(0, CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM kinds WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
    FROM rows
), faulty AS (
    SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault
    FROM placed
), ids AS (
    SELECT DISTINCT conv_id FROM conversations
), edge(frm, ini, op, nxt, price) AS (
    -- Situations: 0 nothing, 1 after s, 2 after u, 3 after a.
    VALUES (0,'s','K',1,0),(0,'u','K',2,0),(1,'u','K',2,0),(3,'u','K',2,0),(2,'a','K',3,0),
           (0,'*','R',2,3),(1,'*','R',2,3),(3,'*','R',2,3),(2,'*','R',3,3),
           (0,'*','D',0,4),(1,'*','D',1,4),(2,'*','D',2,4),(3,'*','D',3,4)
), walk(conv_id, i, s, best) AS (
    SELECT conv_id, 0, s, best FROM ids, (VALUES (0, {'c': 0, 'a': ''}), (2, {'c': 3, 'a': 'I'}), (3, {'c': 6, 'a': 'II'})) AS t(s, best)
    UNION ALL
    SELECT conv_id, i, m.s, min(m.b) FROM (
        SELECT conv_id, i, unnest([{'s': nxt, 'b': step}, {'s': CASE nxt WHEN 2 THEN 3 ELSE 2 END, 'b': {'c': step.c + 3, 'a': step.a || 'I'}}]) AS m
        FROM (
            SELECT w.conv_id, f.i AS i, e.nxt, {'c': w.best.c + e.price + CASE WHEN e.op <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END, 'a': w.best.a || e.op} AS step
            FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN edge e ON e.frm = w.s AND e.ini IN ('*', f.ini)
            WHERE e.op = 'D' OR f.fault IS NULL OR f.fault = 'truncated'
        )
    ) GROUP BY conv_id, i, m.s
), ends AS (
    SELECT conv_id, max(i) AS n FROM walk GROUP BY conv_id
), done AS (
    SELECT w.conv_id, min({'c': w.best.c + CASE w.s WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'a': w.best.a || CASE w.s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}) AS best
    FROM walk w JOIN ends e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.n = w.i
    GROUP BY w.conv_id
), letters AS (
    SELECT conv_id, length(replace(audit, 'D', '')) % 2 AS odd, p, audit[p] AS op, length(replace(audit[1:p], 'I', '')) AS i, length(replace(audit[1:p], 'D', '')) AS o
    FROM (SELECT conv_id, best.a AS audit, unnest(range(1, length(best.a) + 1)) AS p FROM done)
), repaired AS (
    SELECT l.conv_id, string_agg(CASE WHEN op = 'K' THEN f.role ELSE CASE WHEN (o - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN op = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p) AS text
    FROM letters l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i
    WHERE op <> 'D' GROUP BY l.conv_id
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id
)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit,
       sha256(coalesce(r.text, '')) AS repaired_sha256
FROM ids JOIN done d ON d.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM ids.conv_id
""",
}
