"""Gazetteer matching on Spark: load place names, look them up, tag mentions."""

from placewright.plans.gazetteer import Gazetteer
from placewright.plans.search import find, fuzzy, levenshtein, regex, starts_with
from placewright.plans.tagging import tag
from placewright.streaming.tagging import tag_stream

__all__ = [
    "Gazetteer",
    "find",
    "fuzzy",
    "levenshtein",
    "regex",
    "starts_with",
    "tag",
    "tag_stream",
]
