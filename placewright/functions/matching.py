"""Match predicates and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placewright.functions.patterns import translate


def byte_view(text: Column) -> Column:
    """The UTF-8 bytes of a string as a string of one character per byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def edit_distance(left: Column, right: Column, limit: int | None = None) -> Column:
    """Levenshtein distance over code points; -1 beyond ``limit``."""
    if limit is None:
        return F.levenshtein(left, right)
    return F.levenshtein(left, right, limit)


def has_subsequence(text: Column, query: str) -> Column:
    """Whether the bytes of ``query`` occur in ``text`` in order, with any gaps.

    The pattern takes the first occurrence of each byte with possessive steps, so a failing row costs
    one pass and never backtracks.
    """
    steps = "".join(rf"[^\x{byte:02X}]*+\x{byte:02X}" for byte in query.encode())
    return byte_view(text).rlike(rf"(?s)\A{steps}")


def is_subsequence(part: Column, whole: Column) -> Column:
    """Column form of :func:`has_subsequence`.

    A string is a subsequence of another one if and only if their edit distance equals the length
    difference, i.e. insertions alone lead from one to the other. The banded distance with that
    limit stays in generated code, where a pattern per row would have to be compiled per row.
    """
    small, large = byte_view(part), byte_view(whole)
    gap = F.octet_length(whole) - F.octet_length(part)
    return (gap >= 0) & (F.call_function("levenshtein", small, large, gap) >= 0)


def ends_with_match(text: Column, pattern: str) -> Column:
    """Whether the leftmost-first match of ``pattern`` in ``text`` reaches the end of ``text``.

    The atomic group keeps the match that a leftmost-first search would report; only then is the
    end of the text required. In the flags, ``d`` lets ``.`` exclude nothing but newline and ``U``
    makes classes Unicode-aware.
    """
    return text.rlike(rf"(?dU)\A(?>(?s:.)*?(?:{translate(pattern)}))\z")
