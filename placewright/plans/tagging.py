"""Batch lookups: tag a table of mentions with matching places.

All work on matches is done once per distinct mention text; repeated mentions join back in the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.operators.filters import filter_places, place_condition
from placewright.operators.joins import (
    capped_subsequence_pairs,
    exact_pairs,
    levenshtein_pairs,
    once,
    prefix_lengths,
    prefix_pairs,
    subsequence_pairs,
    with_prefixes,
)
from placewright.operators.reduction import leaders, without_beaten
from placewright.plans.gazetteer import Gazetteer
from placewright.plans.results import key_struct, order_columns, ranked, with_entry
from placewright.plans.saved import BEST, PREFIXES, best_postings, deletions, least_by
from placewright.plans.search import limit
from placewright.scratch import written

MODES = ("find", "starts_with", "fuzzy", "levenshtein")
# Mentions of a text that one task gives the matches of the text.
SHARE_MENTIONS = 1_000
DEFAULT_MAX_DIST = {"find": 0, "starts_with": 0, "fuzzy": 0, "levenshtein": 1}


def tag(
    mentions: DataFrame,
    gazetteer: Gazetteer,
    mode: str = "find",
    selection: str = "first",
    max_dist: int | str | None = None,
    *,
    rank: bool = False,
    **place_filter: str | None,
) -> DataFrame:
    """Tag ``mentions(reference, text)``: ``reference, key, entry, distance``.

    ``selection`` keeps the first match of each mention in the order of the single lookups, or all of
    them. Mentions without a match leave no row. ``rank`` adds the position in the mention's results.

    The result is lazy, but some forms run jobs and write tables below ``spark.checkpoint.dir`` first:
    ``rank`` over all results, which reads the matches twice; ``fuzzy`` without a limit, which counts byte
    pairs to choose its join keys; and similarity modes with ``first``, which reduce the terms once.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {', '.join(MODES)}")
    if selection not in ("first", "all"):
        raise ValueError(f"unknown selection {selection!r}, expected first or all")
    k = limit(DEFAULT_MAX_DIST[mode] if max_dist is None else max_dist)
    texts = mentions.select("text").filter(F.col("text").isNotNull())
    if mode != "find":
        # Whatever is longer than all terms has no match; it would have many keys.
        longest = gazetteer.longest_term() + (k if mode == "levenshtein" else 0)
        texts = texts.filter(F.length("text") <= longest)
    texts = texts.distinct()
    if selection == "first":
        matches = _first(texts, gazetteer, mode, k, place_filter)
    else:
        matches = _all(texts, gazetteer, mode, k, place_filter)
        if rank:
            matches = ranked(matches, ["text"], order_columns(mode == "find", True))
    matches = with_entry(matches, gazetteer.places)
    columns = ["text", key_struct(F.col("term")), "entry", "distance"]
    if rank:
        columns.append(F.lit(1).cast("long").alias("rank") if selection == "first" else F.col("rank"))
    matches = matches.select(*columns)
    tagged = mentions.join(matches, "text") if selection == "first" else _each_with_all(mentions, matches)
    return tagged.select("reference", "key", "entry", "distance", *(["rank"] if rank else []))


def _each_with_all(mentions: DataFrame, matches: DataFrame) -> DataFrame:
    """Every mention with all matches of its text.

    The result grows with the product of both, so partitions merged or split by the bytes that they read would leave few
    tasks to make it. Partitions are given by number instead, and the mentions of a frequent text are dealt to shares by
    reference, each with a copy of the matches.
    """
    shares = mentions.groupBy("text").agg(F.ceil(F.count("*") / SHARE_MENTIONS).alias("shares"))
    shares = F.broadcast(shares.filter("shares > 1"))
    n_shares = F.coalesce("shares", F.lit(1).cast("long"))
    n_partitions = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = mentions.join(shares, "text", "left").withColumn("share", F.pmod(F.xxhash64("reference"), n_shares))
    dealt = dealt.select("reference", "text", "share").repartition(n_partitions, "text", "share")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), n_shares - 1))
    copied = matches.join(shares, "text", "left").withColumn("share", copies).drop("shares")
    # A sort-merge join holds the rows of its right side for each key: mentions, a bounded number of narrow rows. And rows that
    # follow each other differ in the reference alone, which files of results pack well.
    return copied.join(dealt, ["text", "share"])


def _pairs(
    texts: DataFrame, dictionary: DataFrame, gazetteer: Gazetteer, mode: str, k: int, keys: DataFrame | None = None
) -> DataFrame:
    """Matching texts and terms; may hold repetitions where :func:`_repeats` says so.

    ``keys`` are saved deletion keys of the dictionary.
    """
    if mode == "find":
        return exact_pairs(texts, dictionary)
    if mode == "starts_with":
        return prefix_pairs(texts, dictionary, k, gazetteer.longest_term())
    if mode == "levenshtein":
        return levenshtein_pairs(texts, dictionary, k, gazetteer.longest_term() if k else None, keys)
    if k:
        return capped_subsequence_pairs(texts, dictionary, k, gazetteer.longest_term(), keys)
    return subsequence_pairs(texts, dictionary, gazetteer.gram_counts())


def _repeats(mode: str, k: int) -> bool:
    return k > 0 and mode in ("fuzzy", "levenshtein")


def _postings(gazetteer: Gazetteer, place_filter: dict) -> DataFrame:
    """Terms of the places that pass the filter."""
    if place_condition(**place_filter) is None:
        return gazetteer.terms
    passing = filter_places(gazetteer.places, **place_filter).select("id")
    return gazetteer.terms.join(passing, "id", "left_semi")


def _leading(gazetteer: Gazetteer, insertion_order: bool, place_filter: dict) -> DataFrame:
    """Postings without most of those that come after another one of their term."""
    postings = _postings(gazetteer, place_filter)
    if insertion_order:
        order = ["src", "file_no", "block"]
        rows = postings.select("*", *[F.col(f"seq.{name}").alias(name) for name in order])
        return without_beaten(rows, "term", order, leaders(rows, "term", order)).drop(*order)
    order = ["ord", "id"]
    whole = place_condition(**place_filter) is None
    return without_beaten(postings, "term", order, gazetteer.vocabulary() if whole else leaders(postings, "term", order))


def _saved(gazetteer: Gazetteer, name: str, place_filter: dict) -> DataFrame | None:
    """A saved table; it holds terms of all places, so a filter cannot use it."""
    return gazetteer.tables.get(name) if place_condition(**place_filter) is None else None


def _all(texts: DataFrame, gazetteer: Gazetteer, mode: str, k: int, place_filter: dict) -> DataFrame:
    postings = _postings(gazetteer, place_filter)
    if mode == "find" or (mode == "levenshtein" and k == 0):
        return exact_pairs(texts, postings)
    best = _saved(gazetteer, BEST, place_filter)
    if best is not None:
        dictionary = best.select("term")
    elif place_condition(**place_filter) is None:
        dictionary = gazetteer.vocabulary().select("term")
    else:
        dictionary = postings.select("term").distinct()
    keys = _saved(gazetteer, deletions(k), place_filter) if k else None
    pairs = _pairs(texts, dictionary, gazetteer, mode, k, keys)
    return (once(pairs) if _repeats(mode, k) else pairs).join(postings, "term")


def _first(texts: DataFrame, gazetteer: Gazetteer, mode: str, k: int, place_filter: dict) -> DataFrame:
    """The least match of each text.

    The order within a term does not depend on the text, so each term is reduced to its least posting
    before terms meet texts: a name that many places share costs as much as any other. Both steps are
    minima, i.e. partial aggregates that also shrink hot groups before the shuffle, and repeated pairs
    do not matter to them. A saved gazetteer has its terms reduced and keyed already.
    """
    best = _saved(gazetteer, BEST, place_filter)
    exact = mode == "find" or (mode == "levenshtein" and k == 0)
    chosen = "earliest.*" if mode == "find" else "least.*"
    if exact and best is None:
        # few postings of a frequent term meet the texts, and terms that no text asks for are gone before the rest is reduced
        asked = _leading(gazetteer, mode == "find", place_filter).join(texts, F.col("term") == F.col("text"), "left_semi")
        best = best_postings(asked)
    if exact:
        return exact_pairs(texts, best).select("text", "term", "distance", chosen)
    if mode == "starts_with":
        prefixes = _saved(gazetteer, PREFIXES, place_filter)
        if prefixes is not None:
            found = texts.join(prefixes, "text")
            return found.filter(F.col("distance") <= k) if k else found
    if best is None:
        best = best_postings(_leading(gazetteer, False, place_filter)).select("term", "least")
        if mode != "starts_with":  # read several times, so made once
            best = written(best)
    if mode == "starts_with":
        return _least_by_prefix(texts, best, k, gazetteer.longest_term())
    texts = written(texts)
    # Nothing comes before the term that equals the text, so texts with one are done.
    winners = exact_pairs(texts, best).select("text", "term", "distance", "least.*")
    rest = written(texts.join(best, F.col("text") == F.col("term"), "left_anti"))
    keys = _saved(gazetteer, deletions(1), place_filter)
    if mode == "fuzzy" and not k and keys is not None:
        # A term with one more character comes before all that are longer, so its texts are done as well.
        near = capped_subsequence_pairs(rest, best.select("term"), 1, gazetteer.longest_term(), keys)
        nearest = written(least_by(near.join(best, "term"), "text"))
        winners = winners.unionByName(nearest)
        rest = written(rest.join(nearest, "text", "left_anti"))
    keys = _saved(gazetteer, deletions(k), place_filter) if k else None
    near = _pairs(rest, best.select("term"), gazetteer, mode, k, keys).join(best, "term")
    return winners.unionByName(least_by(near, "text"))


def _least_by_prefix(texts: DataFrame, best: DataFrame, k: int, longest_term: int) -> DataFrame:
    """The least match of each text as a prefix.

    What is beyond a prefix depends on the term alone, so a prefix has a least match by itself, and
    the terms that share it, however many, are reduced before the shuffle.
    """
    candidates = with_prefixes(best, prefix_lengths(texts, longest_term), k)
    keyed = candidates.withColumn("text", F.substring("term", F.lit(1), F.col("plen")))
    # Not a semi join: it would be pushed below the aggregate, down to all prefixes.
    return least_by(keyed, "text").join(texts, "text")
