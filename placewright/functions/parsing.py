"""Field parsing for the dump formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placewright.schema import MATCH_TYPES

_FLOAT = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)\z"
_EDGE_SPACE = r"(?U)^\s+|\s+\z"
_INTEGER = r"^[+-]?[0-9]+\z"
_UNSIGNED = r"^\+?[0-9]+\z"


def lenient_float(text: Column) -> Column:
    """Trimmed float, NaN where the text is no plain float literal."""
    trimmed = F.regexp_replace(text, _EDGE_SPACE, "")
    parsed = F.when(trimmed.rlike(_FLOAT), trimmed.try_cast("float"))
    return F.coalesce(parsed, F.lit(float("nan")).cast("float"))


def lenient_smallint(text: Column) -> Column:
    """16-bit integer, null where the whole text is none or is out of range."""
    return F.when(text.rlike(_INTEGER), text.try_cast("smallint"))


def strict_id(text: Column) -> Column:
    """Place id; a text that is no unsigned integer fails the query when the row is read."""
    parsed = F.when(text.rlike(_UNSIGNED), text.try_cast("long"))
    problem = F.concat(F.lit("not a place id: "), F.coalesce(text, F.lit("<null>")))
    return F.coalesce(parsed, F.raise_error(problem).cast("long"))


def flag(text: Column) -> Column:
    """True for exactly ``1``."""
    return F.coalesce(text, F.lit("")) == "1"


def alternate_type(preferred: Column, short: Column, colloquial: Column, historic: Column) -> Column:
    """Match type of an alternate name: that of its only flag, or the general one."""
    flags = {
        "PreferredName": preferred,
        "ShortName": short,
        "Colloquial": colloquial,
        "Historic": historic,
    }
    how_many = sum((f.cast("int") for f in flags.values()), F.lit(0))
    named = F.coalesce(*[F.when(f, F.lit(name)) for name, f in flags.items()])
    return F.when(how_many == 1, named).otherwise("Alternate")


def type_ordinal(match_type: Column) -> Column:
    """Rank of a match type in result order."""
    position = F.array_position(F.array(*[F.lit(t) for t in MATCH_TYPES]), match_type)
    return (position - 1).cast("byte")
