"""Single lookups: a query against the terms of a gazetteer.

Each function returns ``key`` and ``entry`` structs, with ``distance`` where there is one, in result
order. A DataFrame keeps its order only until the next shuffle; ``rank=True`` adds it as a column
instead of sorting, for which the matches are written to a table first. All take the place filters
``feature_class``, ``feature_code`` and ``country_code``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.matching import edit_distance, ends_with_match, has_subsequence
from placewright.functions.patterns import checked, required_literals
from placewright.operators.filters import filter_places
from placewright.plans.gazetteer import Gazetteer
from placewright.plans.results import key_struct, order_columns, ranked, with_entry


def find(gazetteer: Gazetteer, query: str, *, rank: bool = False, **place_filter: str | None) -> DataFrame:
    """Terms equal to the query, in insertion order."""
    _require(query)
    matches = gazetteer.terms.filter(F.col("term") == query)
    return _results(gazetteer, matches, order_columns(True, False), rank, place_filter)


def regex(gazetteer: Gazetteer, pattern: str, *, rank: bool = False, **place_filter: str | None) -> DataFrame:
    """Terms whose leftmost match of the pattern reaches their end, by match type and id.

    What a match has to begin with lets the scan skip row groups, and terms without the other texts that it has to
    contain are not matched against the pattern. The JVM's engine backtracks, so patterns with nested repetitions can be slow on long terms.
    """
    _require(pattern)
    checked(gazetteer.terms.sparkSession, pattern)
    term, terms = F.col("term"), gazetteer.terms
    prefix, contained = required_literals(pattern)
    if prefix:
        terms = terms.filter(term.startswith(prefix))
    for literal in contained:
        terms = terms.filter(term.contains(literal))
    matches = terms.filter(ends_with_match(term, pattern))
    return _results(gazetteer, matches, order_columns(False, False), rank, place_filter)


def starts_with(
    gazetteer: Gazetteer,
    query: str,
    max_dist: int | str = 0,
    *,
    rank: bool = False,
    **place_filter: str | None,
) -> DataFrame:
    """Terms that start with the query, within ``max_dist`` edits unless that is 0."""
    _require(query)
    cap = limit(max_dist)
    # All that a term with the prefix differs in is what it has beyond it.
    distance = F.col("term_len") - len(query)
    matches = gazetteer.terms.filter(F.col("term").startswith(query)).withColumn("distance", distance)
    if cap:
        matches = matches.filter(F.col("term_len") <= len(query) + cap)
    return _results(gazetteer, matches, order_columns(False, True), rank, place_filter)


def fuzzy(
    gazetteer: Gazetteer,
    query: str,
    max_dist: int | str = 0,
    *,
    rank: bool = False,
    **place_filter: str | None,
) -> DataFrame:
    """Terms that contain the query's bytes in order, within ``max_dist`` edits unless that is 0."""
    _require(query)
    cap = limit(max_dist)
    matches = gazetteer.terms.filter(has_subsequence(F.col("term"), query))
    if cap:
        matches = _within(matches, query, cap)
    else:
        matches = matches.withColumn("distance", edit_distance(F.lit(query), F.col("term")))
    return _results(gazetteer, matches, order_columns(False, True), rank, place_filter)


def levenshtein(
    gazetteer: Gazetteer,
    query: str,
    max_dist: int | str = 1,
    *,
    rank: bool = False,
    **place_filter: str | None,
) -> DataFrame:
    """Terms within ``max_dist`` edits; 0 asks for equal terms."""
    _require(query)
    matches = _within(gazetteer.terms, query, limit(max_dist))
    return _results(gazetteer, matches, order_columns(False, True), rank, place_filter)


def limit(max_dist: int | str) -> int:
    """A distance limit, given as a number or a numeric string."""
    value = int(max_dist)
    if value < 0:
        raise ValueError(f"negative distance limit {value}")
    return value


def _require(query: str) -> None:
    if not query:
        raise ValueError("empty query")


def _within(terms: DataFrame, query: str, cap: int) -> DataFrame:
    near = terms.filter(F.col("term_len").between(len(query) - cap, len(query) + cap))
    if cap == 0:  # lets the scan skip row groups
        near = near.filter(F.col("term") == query)
    distance: Column = edit_distance(F.lit(query), F.col("term"), cap)
    return near.withColumn("distance", distance).filter("distance >= 0")


def _results(
    gazetteer: Gazetteer, matches: DataFrame, order: list[str], rank: bool, place_filter: dict
) -> DataFrame:
    entries = with_entry(matches, filter_places(gazetteer.entries(), **place_filter))
    columns = [key_struct(F.col("term")), "entry", *(["distance"] if "distance" in matches.columns else [])]
    if rank:
        return ranked(entries, [], order).select(*columns, "rank")
    return entries.orderBy(*order).select(*columns)
