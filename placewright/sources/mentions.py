"""Mention tables: rows of ``(reference, text)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MENTION_SCHEMA = "reference string, text string"


def as_mentions(df: DataFrame) -> DataFrame:
    """``reference`` as a number, whether it came as a number or as a numeric string."""
    return df.select(_reference(F.col("reference")).alias("reference"), F.col("text").cast("string"))


def read_mentions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Mentions from JSON lines."""
    return as_mentions(spark.read.schema(MENTION_SCHEMA).json(path))


def read_mention_stream(spark: SparkSession, path: str) -> DataFrame:
    """Mentions from a directory that JSON-lines files keep arriving in."""
    return as_mentions(spark.readStream.schema(MENTION_SCHEMA).json(path))


#: References are unsigned 32-bit numbers.
LARGEST_REFERENCE = (1 << 32) - 1


def _reference(value: Column) -> Column:
    problem = F.concat(F.lit("not a reference number: "), F.coalesce(value.cast("string"), F.lit("<null>")))
    number = value.try_cast("long")
    return F.when(number.between(0, LARGEST_REFERENCE), number).otherwise(F.raise_error(problem).cast("long"))
