"""Rows that cannot win their group, dropped before Spark aggregates what is left.

An aggregate over records with texts is sort-based: it sorts all rows of a task, and spills where they are many, even if
few groups remain. Numbers are aggregated by hash, without that. So a first pass finds what leads each group by the first
numbers of the order, and a second one drops what comes after; the aggregate over the rest decides as before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.scratch import written

# Rows of a key from which on it is worth while to drop some.
MANY_ROWS = 4
# Keys that are broadcast, the most frequent ones: texts up to a length, and numbers.
MAX_TEXTS, MAX_TEXT_LENGTH, MAX_NUMBERS = 1_000_000, 64, 4_000_000


def leaders(df: DataFrame, key: str, order: list[str], *, largest: bool = False) -> DataFrame:
    """Each key with its number of rows ``n`` and ``lead``, its least ``order``, or its largest, as a written table.

    The last column of ``order`` is a number without nulls, unless the largest is asked for.
    """
    extreme = F.max if largest else F.min
    groups = df.groupBy(key, *order[:-1]).agg(extreme(order[-1]).alias(order[-1]), F.count("*").alias("n"))
    return written(groups.groupBy(key).agg(extreme(F.struct(*order)).alias("lead"), F.sum("n").alias("n")))


def without_beaten(df: DataFrame, key: str, order: list[str], leads: DataFrame) -> DataFrame:
    """``df`` without the rows that come after their key's lead, for the most frequent keys; others stay as they are."""
    most = MAX_NUMBERS
    if dict(leads.dtypes)[key] == "string":
        most, leads = MAX_TEXTS, leads.filter(F.length(key) <= MAX_TEXT_LENGTH)
    # frequent keys by the number of binary digits of their count
    digits = F.length(F.bin("n"))
    sizes = leads.filter(F.col("n") >= MANY_ROWS).groupBy(digits.alias("digits")).agg(F.count("*").alias("n_keys")).collect()
    chosen, total = [], 0
    for size in sorted(sizes, reverse=True):
        total += size.n_keys
        if total > most:
            break
        chosen.append(size.digits)
    if not chosen:
        return df
    known = leads.filter((F.col("n") >= MANY_ROWS) & (digits >= min(chosen)))
    known = known.select(F.col(key).alias("_key"), *[F.col("lead")[name].alias(f"_{name}") for name in order])
    met = df.join(F.broadcast(known), F.col(key) == F.col("_key"), "left")
    leading = F.col("_key").isNull()
    same = F.lit(True)
    for name in order:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return met.filter(leading | same).select(*df.columns)
