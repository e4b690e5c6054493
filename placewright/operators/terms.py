"""From raw rows to search pairs, place records and posting lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.parsing import (
    alternate_type,
    flag,
    lenient_float,
    lenient_smallint,
    strict_id,
    type_ordinal,
)
from placewright.operators.ranking import with_rank
from placewright.operators.reduction import leaders, without_beaten
from placewright.schema import SRC_ALTERNATE, SRC_MAIN


def _seq(src: int, slot: Column) -> Column:
    return F.struct(
        F.lit(src).cast("byte").alias("src"),
        F.col("file_no").cast("int").alias("file_no"),
        F.col("block").cast("long").alias("block"),
        F.col("row").cast("long").alias("row"),
        slot.cast("byte").alias("slot"),
    )


def place_records(raw: DataFrame) -> DataFrame:
    """One typed record per place id; of several rows with an id, the last one read wins.

    The maximum is taken by a partial aggregate, so an id that many rows share shrinks to one row per
    task before the shuffle.
    """
    record = F.struct(
        "name",
        lenient_float(F.col("latitude")).alias("latitude"),
        lenient_float(F.col("longitude")).alias("longitude"),
        *["feature_class", "feature_code", "country_code", "adm1", "adm2", "adm3", "adm4"],
        lenient_smallint(F.col("elevation")).alias("elevation"),
    )
    position = F.struct("file_no", "block", "row")
    keyed = raw.select(strict_id(F.col("id")).alias("id"), record.alias("record"), position.alias("at"))
    return keyed.groupBy("id").agg(F.max_by("record", "at").alias("record")).select("id", "record.*")


def last_rows(raw: DataFrame) -> DataFrame:
    """Main rows without most of those that a later row of their id overwrites; reads the rows once, at once."""
    order = ["file_no", "block", "row"]
    rows = raw.withColumn("id", strict_id(F.col("id")))
    kept = without_beaten(rows, "id", order, leaders(rows, "id", order, largest=True))
    return kept.withColumn("id", F.col("id").cast("string"))


def main_pairs(raw: DataFrame) -> DataFrame:
    """One or two search pairs per main row: the ASCII name, if it differs, then the name."""
    ascii_pair = F.struct(
        F.col("ascii_name").alias("term"), F.lit("AsciiName").alias("type"), F.lit(0).alias("slot")
    )
    name_pair = F.struct(F.col("name").alias("term"), F.lit("Name").alias("type"), F.lit(1).alias("slot"))
    pairs = F.when(F.col("ascii_name") != F.col("name"), F.array(ascii_pair, name_pair)).otherwise(
        F.array(name_pair)
    )
    exploded = raw.select(
        strict_id(F.col("id")).alias("id"), "file_no", "block", "row", F.explode(pairs).alias("pair")
    )
    absent = F.lit(None).cast("string")
    return _pairs(
        exploded,
        term=F.col("pair.term"),
        match_type=F.col("pair.type"),
        lang=absent,
        valid_from=absent,
        valid_to=absent,
        seq=_seq(SRC_MAIN, F.col("pair.slot")),
    )


def in_languages(languages: Sequence[str] | None) -> Column:
    """Whether an alternate row has one of the language codes; no or an empty list keeps all."""
    return F.col("lang").isin(list(languages)) if languages else F.lit(True)


def alternate_pairs(
    raw: DataFrame, place_ids: DataFrame, languages: Sequence[str] | None = None
) -> DataFrame:
    """One search pair per alternate row in the given languages whose place exists.

    A bad id fails the load only where the row's language is wanted; the check repeats the language
    condition, as the optimizer may reorder it with the filter.
    """
    wanted = in_languages(languages)
    kept = raw.filter(wanted).withColumn("id", F.when(wanted, strict_id(F.col("id"))))
    known = kept.join(place_ids.select("id"), "id", "left_semi")
    flags = [flag(F.col(name)) for name in ("preferred", "short", "colloquial", "historic")]
    known = known.withColumn("type", alternate_type(*flags))
    historic = F.col("type") == "Historic"
    return _pairs(
        known,
        term=F.col("name"),
        match_type=F.col("type"),
        lang=F.col("lang"),
        valid_from=F.when(historic, F.col("from")),
        valid_to=F.when(historic, F.col("to")),
        seq=_seq(SRC_ALTERNATE, F.lit(0)),
    )


def _pairs(
    rows: DataFrame,
    *,
    term: Column,
    match_type: Column,
    lang: Column,
    valid_from: Column,
    valid_to: Column,
    seq: Column,
) -> DataFrame:
    return rows.select(
        term.alias("term"),
        match_type.alias("type"),
        type_ordinal(match_type).alias("ord"),
        "id",
        lang.alias("lang"),
        valid_from.alias("from"),
        valid_to.alias("to"),
        seq.alias("seq"),
        F.length(term).alias("term_len"),
    )


def searchable(pairs: DataFrame) -> DataFrame:
    """Search pairs that can be found; empty terms cannot."""
    return pairs.filter(F.col("term") != "")


def posting_lists(terms: DataFrame) -> DataFrame:
    """Each term's matches in insertion order, as rows with a position from 1 up.

    The lists stay flat. An array per term would put all matches of a frequent name into one row;
    here even the numbering of one list is dealt over as many tasks as it fills.
    """
    return with_rank(terms, [F.col("term")], [F.col("seq")], name="position")
