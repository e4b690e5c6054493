"""Chat formatting: collapse logged snapshots of conversations, then render those that are left.

A logged conversation that is the beginning of a longer one says nothing new. Every conversation gets
the rolling hashes of its turn prefixes; an anti-join with the hashes of proper prefixes leaves the
maximal conversations, of equal ones the one with the smallest id, and these are rendered. Hashes are
aggregated before they meet, so a first turn, or a whole conversation, shared by any number of
conversations is one row there. All of it are DataFrame functions.

A rendered conversation is one value, so the turns of one ``conv_id`` meet in one row; nothing larger
does. Defined cases: turns are ordered by number, then role, then text, null first; a repeated row
counts once; a null role or text differs from an empty one as a hash and is empty when rendered; rows
with a null ``conv_id`` belong to no conversation and are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.scratch import written

#: The marks that open and close a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def safe(text: Column) -> Column:
    """Text that cannot be taken for a mark."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def conversations_with_prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id``, its turns in order, and the rolling hash after each turn."""
    turns = turns.where(F.col("conv_id").isNotNull())
    row = F.struct(*[F.col(c).alias(c) for c in ("turn", "role", "text")])
    logged = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_set(row)).alias("turns"))

    def extended(hashes: Column, turn: Column) -> Column:
        last = F.coalesce(F.get(hashes, F.size(hashes) - 1), F.lit(""))
        return F.concat(hashes, F.array(F.md5(F.concat(last, F.to_json(F.struct(turn["role"], turn["text"]))))))

    return logged.withColumn("prefixes", F.aggregate("turns", F.array().cast("array<string>"), extended))


def maximal(logged: DataFrame) -> DataFrame:
    """The kept ``conv_id`` of every conversation that no longer one begins with, and its number of copies."""
    whole = logged.groupBy(F.element_at("prefixes", -1).alias("whole"))
    whole = whole.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = F.expr("slice(prefixes, 1, size(prefixes) - 1)")
    proper = logged.select(F.explode(proper).alias("whole")).distinct()
    return whole.join(proper, "whole", "left_anti").select("conv_id", "n_copies")


def rendered(turns: Column) -> Column:
    texts = F.transform(turns, lambda t: F.concat(F.lit(OPEN), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit(f"{CLOSE}\n")))
    return F.array_join(texts, "")


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns``, ``n_copies`` and ``rendered`` of each maximal conversation."""
    logged = written(conversations_with_prefixes(turns))
    kept = logged.join(maximal(logged), "conv_id")
    return kept.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", rendered(F.col("turns")).alias("rendered"))
