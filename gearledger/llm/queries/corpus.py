"""Queries over documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearledger.llm import automata, language, merkle, secrets, simhash, substrings, tokencount, toxicity
from gearledger.llm.common import documents, held_out, table
from gearledger.llm.mixing import mix, mixed_sizes
from gearledger.llm.packing import pack, public_byte_bpe


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    pieces = pack(documents(spark, sf_dir), public_byte_bpe, end_id=1, length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes of each."""
    return mixed_sizes(mix(documents(spark, sf_dir)))


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return merkle.fingerprints(documents(spark, sf_dir)).drop("changed_sections")


def _pieces() -> list[tuple[str, float]]:
    return tokencount.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram pieces of every document."""
    return tokencount.token_counts(documents(spark, sf_dir), _pieces)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = documents(spark, sf_dir)
    model = language.fit(docs.filter(~held_out()))
    return language.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows that are not held out."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text").join(labels, "doc_id"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in every document."""
    found = secrets.scan(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.concat("base", "linked")).alias("spans"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near-duplicates of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that occur more than once."""
    found = substrings.remove_repeats(documents(spark, sf_dir))
    span = F.transform("removed", lambda r: r["end"] - r["start"])
    return found.select(
        "doc_id", "n_bytes", F.aggregate(span, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the sequences of 35 words that occur more than once."""
    found = automata.remove_repeats(documents(spark, sf_dir))
    span = F.transform("removed", lambda r: r["end"] - r["start"])
    return found.select(
        "doc_id", "n_words", F.aggregate(span, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_packing": op2_packing, "op3_mixing": op3_mixing, "op4_merkle": op4_merkle, "op5_token_counts": op5_token_counts,
           "op6_secrets": op6_secrets, "op7_simhash": op7_simhash, "op8_language": op8_language, "op9_toxicity": op9_toxicity, "op10_substrings": op10_substrings,
           "op12_automata": op12_automata}
ORACLES = {
    "op12_automata": r"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT row, start, md5(array_to_string(words[start:start + 34], ' ')) AS content FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS start FROM texts)
), again AS (
    SELECT row, start FROM (SELECT row, start, count(*) OVER (PARTITION BY content) AS n FROM windows) WHERE n > 1
), gone AS (
    SELECT DISTINCT row, start + step AS at FROM again, range(0, 35) AS t(step)
), kept AS (
    SELECT t.row, string_agg(t.word, ' ' ORDER BY t.at) AS text
    FROM (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM texts) t ANTI JOIN gone g ON g.row = t.row AND g.at = t.at
    GROUP BY t.row
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts LEFT JOIN (SELECT row, count(*) AS n FROM gone GROUP BY row) g USING (row) LEFT JOIN kept k USING (row)
""",
}
