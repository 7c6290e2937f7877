"""From raw documents to token counts and digests of token ids and decoded texts in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it
kept; its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents, others of the same table included.

Defined results: a null or empty text is clean of toxic words as far as the classifier
tells, loses no line, is a near copy of all others without words (one stays), holds no
benchmark window, and has no ids. Of rows equal in id and text one stays after the
SimHash stage, and of a group of near copies the row of the smallest id (ties: of the
smallest text digest; a null id comes last). A score of just its threshold rejects. Very
long texts pass through every stage whole. Empty tables give no rows; without labels
nothing is toxic, without benchmark items nothing is contaminated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe_codec, decontam, line_dedup, simhash, store, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold of their language."""
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, net)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows cut from the texts; n_chars follows."""
    return line_dedup.dedup_lines(docs, length_col="n_chars")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the documents that are left."""
    return bpe_codec.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: The classifier, XXH64 fingerprints and the tokenizer aren't within SQL's reach; tests
#: hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name)
        if before is not None:
            store.forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
