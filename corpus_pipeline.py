"""A corpus pipeline of five stages, each an operator of ``placewright.llm`` on all that the stage before kept.

Toxic documents go; repeated lines go, and their documents stay; of each group of similar documents the one with the
least id stays; sources are mixed to their target weights, by which documents can go or come several times; the
rest is encoded as pieces. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placewright.llm.jaccard_join import one_of_each
from placewright.llm.line_dedup import deduped
from placewright.llm.mixing import mixed
from placewright.llm.pieces import encode
from placewright.llm.tables import read
from placewright.llm.toxicity import without_toxic
from placewright.scratch import written

#: SQL can express neither the classifier nor the encoder, so the pipeline is tested against a plain version.
ORACLE_SQL = None

#: Words of a shingle, and how alike (in %) the shingles of two documents are of which one goes.
SHINGLE, PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduped(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, SHINGLE, PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
