"""The star-schema test tables seen as a gazetteer.

They hold no places, so parts stand in for them: `part` gives the main rows, `customer` the alternate
names, `orders` and `events` the mentions. Names are ``<p_name> <p_type> <p_brand>``, of which there are
up to 9,600.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.schema import ALTERNATE_COLUMNS, MAIN_COLUMNS, POSITION_FIELDS


def part_name() -> Column:
    return F.concat_ws(" ", "p_name", "p_type", "p_brand")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _positioned(df: DataFrame, columns: list[str], given: dict, at: str) -> DataFrame:
    """All dump columns as strings, and the key as position: one block per 2^20 rows."""
    values = [given.get(name, F.lit("")).cast("string").alias(name) for name in columns]
    position = [
        F.lit(0).alias("file_no"),
        F.shiftright(F.col(at), 20).cast("long").alias("block"),
        F.col(at).cast("long").alias("row"),
    ]
    return df.select(*values, *position).select(*columns, *POSITION_FIELDS)


def raw_places(spark: SparkSession, sf_dir: str, rows_per_id: int = 1) -> DataFrame:
    """Main rows; with more than one row per id, later rows overwrite earlier ones."""
    given = {
        "id": F.expr(f"p_partkey div {rows_per_id}"),
        "name": part_name(),
        "ascii_name": F.when(F.col("p_partkey") % 3 == 0, F.replace(part_name(), F.lit("e"), F.lit("a"))).otherwise(
            part_name()
        ),
        "latitude": F.col("p_size"),
        "longitude": F.col("p_retailprice"),
        "feature_class": F.substring("p_type", 1, 1),
        "feature_code": F.col("p_type"),
        "country_code": F.col("p_brand"),
        "elevation": F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string")).otherwise(""),
    }
    return _positioned(table(spark, sf_dir, "part"), MAIN_COLUMNS, given, "p_partkey")


def raw_alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternate rows; a third or so belong to no place."""

    def divisible(by: int):
        return F.when(F.col("c_custkey") % by == 0, "1").otherwise("")

    given = {
        "row_id": F.col("c_custkey"),
        "id": F.col("c_custkey") * 2,
        "lang": F.lower("c_mktsegment"),
        "name": F.col("c_name"),
        "preferred": divisible(2),
        "short": divisible(3),
        "colloquial": divisible(5),
        "historic": divisible(7),
        "from": F.col("c_nationkey"),
        "to": F.col("c_nationkey") + 100,
    }
    return _positioned(table(spark, sf_dir, "customer"), ALTERNATE_COLUMNS, given, "c_custkey")


def order_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mention per order, in four kinds: a name, its beginning, a misspelt one, an alternate name."""
    orders, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    joined = orders.join(part, F.col("o_custkey") == F.col("p_partkey"))
    kind = F.col("o_orderkey") % 4
    beginning = F.substring(part_name(), F.lit(1), F.length(part_name()) - 2)
    misspelt = F.concat(F.substring(part_name(), 1, 1), F.substring(part_name(), F.lit(3), F.length(part_name())))
    alternate = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    text = F.when(kind == 0, part_name()).when(kind == 1, beginning).when(kind == 2, misspelt).otherwise(alternate)
    return joined.select(F.col("o_orderkey").alias("reference"), text.alias("text"))


def event_mentions(events: DataFrame, part: DataFrame) -> DataFrame:
    """One mention per event: a name. `events` may be a stream."""
    joined = events.join(part, F.col("user_id") == F.col("p_partkey"))
    return joined.select(F.col("event_id").alias("reference"), part_name().alias("text"))


def raw_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main rows from documents: one per word, with the document's id, so that terms hold any script.

    Rows of a document share its id and overwrite each other; all of their terms stay.
    """
    documents = table(spark, sf_dir, "documents")
    words = documents.select("doc_id", "lang", F.posexplode(F.split("text", r"\s+")).alias("at", "word"))
    given = {
        "id": F.col("doc_id"),
        "name": F.col("word"),
        "ascii_name": F.translate("word", "éèêàçù", "eeeacu"),
        "country_code": F.col("lang"),
    }
    return words.select(
        *[given.get(name, F.lit("")).cast("string").alias(name) for name in MAIN_COLUMNS],
        F.lit(0).alias("file_no"),
        F.col("doc_id").alias("block"),
        F.col("at").cast("long").alias("row"),
    )


def turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all conversations, with the conversation as reference."""
    words = F.explode(F.split("text", r"\s+"))
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("reference"), words.alias("text"))
