"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.scratch import written

#: Bits of ``monotonically_increasing_id`` below the number of the partition.
_ROW_BITS = 33


def with_rank(
    df: DataFrame,
    group: Sequence[Column],
    order: Sequence[Column],
    *,
    ranges: Sequence[Column] | None = None,
    name: str = "rank",
    place: str | None = None,
) -> DataFrame:
    """Add the row number within ``group`` by ``order``, without sorting a group in one task.

    Rows are dealt by ranges of group and order, whose borders Spark draws from a sample of the data, and
    each range is sorted and written. So the pieces follow the data: a group that holds most rows fills
    many ranges. What a range holds of a group is counted, and the counts of the ranges before are added:
    one row per range and group. Only rows that are equal in group and order cannot be dealt.

    ``ranges`` may give shorter columns to draw borders from than ``order``, such as beginnings of long
    texts; ordering by them first must not change the order. ``place`` names a column for the place of the
    row in the whole table, which is unique. ``df`` is computed twice, for the sample and for the table.
    """
    keys = [f"_k{i}" for i in range(len(group))]
    keyed = df.select("*", *[c.alias(k) for c, k in zip(group, keys, strict=True)])
    dealt = keyed.repartitionByRange(*keys, *(order if ranges is None else ranges))
    table = written(dealt.sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    table = table.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    pieces = table.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    before = F.sum("_size").over(
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = pieces.select(
        *[F.col(k).alias(f"{k}_") for k in keys],
        F.col("_part").alias("_part_"),
        (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_offset"),
    )
    same = F.col("_part") == F.col("_part_")
    for k in keys:  # a null is a group as well
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    numbered = table.join(offsets, same).withColumn(name, F.col("_at") + F.col("_offset"))
    if place:
        numbered = numbered.withColumn(place, F.col("_at"))
    return numbered.drop("_at", "_part", "_part_", "_offset", *keys, *[f"{k}_" for k in keys])
