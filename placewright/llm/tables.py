"""What several operators share: the word pattern, and narrow views of the tables."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
OTHER_SPACE = r"[\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that no other column can clash; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def words(text: Column) -> Column:
    """The words of a text as an array, without empty ones."""
    # splitting at one plain character needs no regular expression, and few texts hold another white space
    plain = F.when(text.rlike(OTHER_SPACE), F.regexp_replace(text, OTHER_SPACE, " ")).otherwise(text)
    return F.array_remove(F.split(plain, " "), "")


def packed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in one struct ``row``, so that none can clash; beside it ``doc_id`` and ``text``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))


def unpacked(docs: DataFrame, rows: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from ``row``, in order and with their types; some of them changed."""
    given = {f.name: changed.get(f.name, F.col("row").getField(f.name)).cast(f.dataType) for f in docs.schema.fields}
    return rows.select(*[column.alias(name) for name, column in given.items()])


def shipped(spark: SparkSession, value) -> Callable[[], Any]:
    """A broadcast of any Python object, with the code of its class: call the result in a task to get it."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)
