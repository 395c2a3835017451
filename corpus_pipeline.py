"""A corpus from documents to packed token sequences: language, near-duplicates, secrets, mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; its result is written as Parquet and read again
as the next one's documents. All but the last return the columns of documents, whatever their names.

Defined results: a null or blank text has no language and goes in the first stage; null ids are ids like any other. Rows of one text fall
into one group of near copies, of which the smallest id stays (null ids last), once. Secrets don't drop rows. A document that the mix doesn't take goes, one that it takes
twice is there twice. An empty table, or one without labels, gives no rows in all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearledger.llm import language, mixing, packing, secrets, simhash
from gearledger.llm.common import cut_lineage, documents, held_out

#: The main language must make up this share of a text; texts in two languages pass.
LEAST_SHARE = 0.25


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a missing language label is filled with the predicted one."""
    model = language.fit(docs.filter(~held_out()))
    known = language.identify(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: word shingles of five, similarity of 0.8 or more."""
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind."""
    return secrets.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix; a document taken twice is there twice."""
    return mixing.mixed_documents(docs, mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: doc_id, start, length, doc_tokens, ids, sequence_id, offset."""
    return packing.pack(docs, packing.public_byte_bpe, end_id=1, length=2048)


STAGES = [
    ("language", by_language),
    ("near_copies", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: Mixture inference, seeded permutations and tokenizers have no SQL form. tests/llm holds the stages of near copies, secrets and packing against brute force each,
#: and run() against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
