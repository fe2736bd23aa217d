"""A training-corpus pipeline: language, copies, near copies, mix, packing.

Every stage is a function of (spark, docs, sf_dir). Its result is written as
Parquet and read again as the next one's documents, so a stage's decisions take
effect on all that its predecessor kept. All stages but the last return rows
with the columns of ``docs``, whatever their names; rows that repeat are allowed
everywhere, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phylospark.llm import exact_dedup, langid, mixing, packing, simhash
from phylospark.llm.queries import tokenizer_path
from phylospark.shared import cut

#: Documents that a Python worker gets at once.
BATCH_ROWS = 1000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: over half of the probability pooled over the whole text is one language's.

    Null and empty texts, texts without a letter and texts between languages
    go. The network learns from the labelled documents of the table; without
    labels nothing is determined and nothing stays. Long texts are read whole.
    """
    return langid.known_language(docs, batch_rows=BATCH_ROWS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that are equal but for white space.

    Null texts are empty and, like empty ones, one class. The one with most
    code points stays, of those the one with the smallest id (a null id last).
    """
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints, the one with the smallest id.

    Null and blank texts have fingerprint zero and are one group. Long texts
    are read whole; rows that share an id are told apart by fingerprint.
    """
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: never, once or twice.

    Null texts have no words; a null source is a source. Rows that share an id
    are taken alike.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences and places; repeated rows each get theirs, null and empty texts are an end token."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: Language identification and packing are not SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
