"""Statistics of a gazetteer and the provenance of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.plans.gazetteer import Gazetteer
from placewright.schema import DATE_LABEL

TOOL_NAME = "placewright"


def catalogue_stats(gazetteer: Gazetteer) -> DataFrame:
    """Number of places and of distinct terms."""
    places = gazetteer.places.agg(F.count("*").alias("n_places"))
    terms = gazetteer.terms.agg(F.count_distinct("term").alias("n_terms"))
    return places.select("n_places", terms.scalar().alias("n_terms"))


def data_date(spark: SparkSession, path: str) -> str:
    """The label in a text file, trimmed."""
    text = spark.read.text(path, wholetext=True).first()
    return text.value.strip() if text else ""


def provenance(
    spark: SparkSession, date: str | None = None, languages: Sequence[str] | DataFrame | None = None
) -> DataFrame:
    """One row: the tool, the time in seconds, and a comment on the data's date and languages.

    Absent parts are left out of the comment. ``languages`` is the list that the gazetteer was loaded
    with, or a table with a column ``lang`` whose distinct values are listed in order.
    """
    if isinstance(languages, DataFrame):
        codes = languages.agg(F.array_sort(F.collect_set("lang")).alias("codes"))
    else:
        listed = F.array(*[F.lit(code) for code in languages]) if languages else F.lit(None)
        codes = spark.range(1).select(listed.cast("array<string>").alias("codes"))
    quoted = F.transform("codes", lambda code: F.concat(F.lit("'"), code, F.lit("'")))
    parts = [
        F.lit(None if date is None else f"{DATE_LABEL}{date}").cast("string"),
        F.concat(F.lit("Languages: "), F.array_join(quoted, ", ")),
    ]
    return codes.select(
        F.lit(TOOL_NAME).alias("user"),
        F.unix_timestamp().alias("timestamp"),
        F.concat_ws("; ", *parts).alias("comment"),
    )
