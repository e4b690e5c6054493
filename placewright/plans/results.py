"""Shape and order of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.operators.ranking import with_rank
from placewright.scratch import written
from placewright.schema import KEY_FIELDS, PLACE_FIELDS


def key_struct(term: Column) -> Column:
    return F.struct(term.alias("name"), *[F.col(f"`{name}`") for name in KEY_FIELDS[1:]]).alias("key")


def with_entry(matches: DataFrame, places: DataFrame) -> DataFrame:
    """Add the place record of each match; a match whose place was filtered out goes."""
    entry = places.select("id", F.struct(*PLACE_FIELDS).alias("entry"))
    return matches.join(entry, "id")


def order_columns(insertion_order: bool, with_distance: bool) -> list[str]:
    """Result order: as inserted, or by (distance,) match type and id with the term and insertion last."""
    if insertion_order:
        return ["seq"]
    return [*(["distance"] if with_distance else []), "ord", "id", "term", "seq"]


def least_posting(insertion_order: bool) -> Column:
    """The least posting of a group, by all that orders results but the distance and the term."""
    order = [name for name in order_columns(insertion_order, False) if name != "term"]
    rest = [name for name in ["ord", "id", "seq", "type", "lang", "from", "to"] if name not in order]
    return F.min(F.struct(*order, *rest))


def ranked(matches: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add the position of each match in the result list of its group.

    The matches are written to a table first, as numbering them reads them twice.
    """
    return with_rank(written(matches), [F.col(name) for name in group], [F.col(name) for name in order])
