"""A corpus pipeline: toxicity, exact dedup, near-dedup, mixing, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, an empty one for an empty table; ``run`` writes each stage's rows to the shared folder
and reads them again as the next one's docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact_dedup, mixing, simhash_dedup, toxicity
from tidemark.llm.common import table, written
from tidemark.storage import discard, mark


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict toxic; null texts count as empty, repeated rows go together."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; null texts equal empty ones, of repeated rows one stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; rows without an id stay, blank texts are alike."""
    return simhash_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixing plan takes them; a null language or source is a leaf of its own."""
    return mixing.draw(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per drawn document its number of tokens and the digests of its ids and of the decoded bytes."""
    # texts are long: smaller batches to the Python workers, which come after stages that have filled the executors' heaps
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: The toxicity model, the SimHash and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; of the tables on the way only the result is left."""
    docs, since = table(spark, sf_dir, "documents"), mark(spark)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        discard(spark, since, keep=1)
    return docs
