"""Conditions on the place that a match points to."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place_condition(
    feature_class: str | None = None, feature_code: str | None = None, country_code: str | None = None
) -> Column | None:
    """Conjunction of the given equalities; ``None`` if there are none."""
    wanted = {"feature_class": feature_class, "feature_code": feature_code, "country_code": country_code}
    conditions = [F.col(name) == value for name, value in wanted.items() if value is not None]
    return functools.reduce(operator.and_, conditions) if conditions else None


def filter_places(places: DataFrame, **wanted: str | None) -> DataFrame:
    """Places that pass; filtering them before the join equals filtering the results after it."""
    condition = place_condition(**wanted)
    return places if condition is None else places.filter(condition)
