"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

All stages but the last return the columns of documents, whatever others there are beside doc_id, text and source, and an empty
table for an empty table. Very long texts are handled piece by piece or alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domgraph.llm import decontaminate, mixture, scratch, simhash, token_output, toxicity
from domgraph.llm.catalog import END_ID, TOKENIZER, TOXIC_FROM


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold.

    Each row is judged by its text: equal texts stay or go together, and a null or empty text has the score of no words. Without
    usable labels every row stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    usable = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    return toxicity.keep_clean(docs, toxicity.train(docs, labels, usable), TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more).

    The smallest doc_id of a group stays, and rows that share a doc_id stay or go together; rows without doc_id stay. Texts without
    words (null, empty, white space) are copies of each other only where they are equal, null counting as empty.
    """
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Each row is judged by its own text, with or without doc_id; null and empty texts stay, and null or empty items match nothing.
    """
    return decontaminate.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each a whole number of times.

    A null source is a source of its own; null and empty texts have no words and go; rows that share a doc_id are taken equally
    often. The schedule cuts one document or two of a source, whose rounding is all that moves a source from its target.
    """
    return mixture.repeat_by_mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the token files of all that is left.

    In ascending doc_id order, null first; copies are documents each; a null text would be the end id alone.
    """
    return token_output.encode_and_digest(docs, public_tokenizers.path(TOKENIZER), end_id=END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixture", mix_sources),
    ("token_output", write_tokens),
]
#: Trained scores, shingle similarity and tokenization have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
