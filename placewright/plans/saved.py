"""Tables of a saved gazetteer that joins need not make, shuffle or reduce again.

All are bucketed by the column that texts and matches are joined on, so a batch shuffles what it brings and
nothing of the gazetteer. Each has one row per place, term, prefix, or key and term: a name that many places share
is one row, so buckets are even. Bucketing needs a table of the session's catalogue; its name is made from the
path, and a session that does not have it declares it over the files that are there.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.operators.joins import keyed_terms, longest_for_deletions
from placewright.plans.results import least_posting

PLACES, BEST, PREFIXES = "places", "best", "prefixes"
#: The column that each table is bucketed by.
BUCKETED_BY = {PLACES: "id", BEST: "term", PREFIXES: "text"}
FACTS = "facts"


def deletions(k: int) -> str:
    """The name says which terms have keys: one that was saved with another limit is not taken."""
    return f"deletions_{k}_up_to_{longest_for_deletions(k)}"


def best_postings(postings: DataFrame) -> DataFrame:
    """Each term with its least posting in the order of similarity results, and its earliest."""
    return postings.groupBy("term").agg(least_posting(False).alias("least"), least_posting(True).alias("earliest"))


def least_by(candidates: DataFrame, key: str) -> DataFrame:
    """The least of the candidates ``(term, distance, least)`` of each key."""
    choice = F.min(F.struct("distance", "least.ord", "least.id", "term", "least.seq", "least"))
    chosen = candidates.groupBy(key).agg(choice.alias("w"))
    return chosen.select(key, "w.term", "w.distance", "w.least.*")


def best_by_prefix(best: DataFrame) -> DataFrame:
    """The least term of every prefix of a term; what is left of the term is its distance."""
    lengths = F.sequence(F.lit(0), F.length("term"))
    cut = best.select("term", "least", F.explode(lengths).alias("plen"))
    text = F.substring("term", F.lit(1), F.col("plen")).alias("text")
    return least_by(cut.select(text, "term", "least", (F.length("term") - F.col("plen")).alias("distance")), "text")


def save_tables(places: DataFrame, terms: DataFrame, path: str, distances: tuple[int, ...], prefixes: bool) -> None:
    """Write the tables below ``path``; ``terms`` should be a scan of what is already saved."""
    spark = terms.sparkSession
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    longest = terms.agg(F.max("term_len").alias("longest")).first().longest or 0
    _save(places, path, PLACES, n_buckets)
    best = _save(best_postings(terms), path, BEST, n_buckets)
    if prefixes:
        _save(best_by_prefix(best), path, PREFIXES, n_buckets)
    for k in distances:
        short = best.select("term").filter(F.length("term") <= longest_for_deletions(k))
        _save(keyed_terms(short, k), path, deletions(k), n_buckets)
    names = [PLACES, BEST, *([PREFIXES] if prefixes else []), *map(deletions, distances)]
    facts = json.dumps({"longest_term": longest, "n_buckets": n_buckets, "tables": names})
    spark.createDataFrame([(facts,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{FACTS}")


def load_tables(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """What is known of the gazetteer saved below ``path``, and its bucketed tables."""
    facts = json.loads(spark.read.text(f"{path}/{FACTS}").first().value)
    return facts, {name: _declared(spark, path, name, facts["n_buckets"]) for name in facts["tables"]}


def _column(name: str) -> str:
    return BUCKETED_BY.get(name, "key")


def _table(path: str, name: str) -> str:
    return f"placewright_{hashlib.md5(path.encode()).hexdigest()}_{name}"


def _save(df: DataFrame, path: str, name: str, n_buckets: int) -> DataFrame:
    column = _column(name)
    # dealt as the buckets are, so that each is one file
    writer = df.repartition(n_buckets, column).write.format("parquet").mode("overwrite").bucketBy(n_buckets, column).sortBy(column)
    if dict(df.dtypes)[column] == "string":  # a term that is not there reads no row group
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.option("path", f"{path}/{name}").saveAsTable(_table(path, name))
    return df.sparkSession.table(_table(path, name))


def _declared(spark: SparkSession, path: str, name: str, n_buckets: int) -> DataFrame:
    table, column = _table(path, name), _column(name)
    if not spark.catalog.tableExists(table):
        schema = spark.read.parquet(f"{path}/{name}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE `{table}` ({columns}) USING parquet "
            f"CLUSTERED BY (`{column}`) SORTED BY (`{column}`) INTO {n_buckets} BUCKETS LOCATION '{path}/{name}'"
        )
    return spark.table(table)
