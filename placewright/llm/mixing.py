"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks.

Every source gets a target of words. Targets are turned into whole blocks of ``block`` words by the
Sainte-Laguë method (the highest quotients ``target / (2 k + 1)`` get the seats), first between
sources, then within each source between its shards, which are seeded buckets of bounded size. The
documents of a shard, in seeded order, form a stream of blocks; the shard takes as many of its
blocks as its quota says, starting anew once the stream is used up.

Only the word counts of the documents are shuffled, never texts; the largest group that one task
sorts is a shard. All of it are DataFrame functions.

Defined cases: a null text has no words; a null source is a source of its own, the last one; a null
``doc_id`` is ordered like an empty one; repeated rows are documents of their own; documents without
words take nothing; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.tables import WORD, packed, unpacked
from placewright.scratch import written

WEIGHTS = (5, 2, 1)
#: Words asked for in all, per 100 words there are; and a source's most, in times its size.
PERCENT, MOST = 150, 2
BLOCK, SHARD_WORDS, SEED = 16, 1 << 20, "mix"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def apportion(parties: DataFrame, by: list[str], votes: str, house: str, order: list[Column], name: str) -> DataFrame:
    """Seats for every party by the Sainte-Laguë method, as column ``name``.

    ``house`` is the number of seats to give away within each group of ``by``, ``order`` breaks ties.
    Rounding moves a party by no more than its share of half the number of parties, so seats below
    that band are given at once, and only the quotients within it are ranked.
    """
    group = Window.partitionBy(*[F.col(c) for c in by]) if by else Window.partitionBy(F.lit(0))
    total = F.sum(votes).over(group)
    parties = parties.withColumn("_share", F.when(total > 0, F.col(votes) / total).otherwise(0.0))
    parties = parties.withColumn("_band", (F.ceil(F.count("*").over(group) * F.col("_share")) + 2).cast("long"))
    exact = F.col(house) * F.col("_share")
    parties = parties.withColumn("_sure", F.greatest(F.lit(0), F.floor(exact) - F.col("_band")).cast("long"))
    parties = parties.withColumn("_open", F.col(house) - F.sum("_sure").over(group))
    seats = parties.withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_sure") + 2 * F.col("_band") + 2)))
    ranked = group.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), *order, F.col("_k"))
    seats = seats.withColumn("_won", (F.row_number().over(ranked) <= F.col("_open")) & (F.col(votes) > 0))
    kept = [c for c in parties.columns if not c.startswith("_")]
    won = F.sum(F.col("_won").cast("long")).cast("long")
    return seats.groupBy(*kept, "_sure").agg((F.col("_sure") + won).alias(name)).drop("_sure")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source``, its rank, size and target: water filling in closed form over the sorted sources."""
    everything = Window.partitionBy(F.lit(0))
    by_source = everything.orderBy(F.col("source").asc_nulls_last())
    pick = F.pmod(F.row_number().over(by_source) - 1, F.lit(len(WEIGHTS)))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("source_no", F.row_number().over(by_source))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (pick + 1).cast("int")).cast("long"))
    sources = sources.withColumn("most", MOST * F.col("source_size"))
    full_at = F.col("most") / F.col("weight")  # the level at which a source is full
    rising = everything.orderBy(full_at, "source_no")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    asked = F.sum("source_size").over(everything) * (PERCENT / 100)
    left = asked - F.coalesce(F.sum("most").over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    sources = sources.withColumn("asked", asked).withColumn("full_at", full_at).withColumn("level", left / weights)
    # the first source that the level does not fill tells the level of all
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_no", "level"))).over(everything)
    target = F.least(F.col("most").cast("double"), F.col("weight") * level["level"])
    sources = sources.withColumn("target", F.coalesce(target, F.col("most").cast("double")))
    return sources.select("source", "source_no", "source_size", "target", "asked")


def mix(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` for every row of ``docs``."""
    return _taken(docs, block, shard_words, seed).drop("part")


def _taken(docs: DataFrame, block: int, shard_words: int, seed: str) -> DataFrame:
    """The result of ``mix`` with ``part``, a hash of the text, which tells rows of one id apart."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        word_count(F.col("text")).alias("size"),
        digest.alias("digest"),
        F.xxhash64("text").alias("part"),
    )
    sizes = written(sizes)
    sources = source_targets(sizes).withColumn("house", F.floor(F.col("asked") / block + 0.5))
    sources = apportion(sources, [], "target", "house", [F.col("source_no")], "blocks")
    sources = sources.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    sources = written(sources.select("source", "source_no", "source_size", "target", "blocks", "n_shards"))

    bucket = F.conv(F.substring("digest", 1, 12), 16, 10).cast("long")
    own = sources.withColumnRenamed("source", "_source")
    dealt = sizes.join(own, sizes["source"].eqNullSafe(own["_source"])).drop("_source")
    dealt = dealt.withColumn("shard", F.pmod(bucket, F.col("n_shards")))
    shards = dealt.groupBy("source_no", "shard", "blocks").agg(F.sum("size").alias("words"))
    shards = apportion(shards, ["source_no"], "words", "blocks", [F.col("shard")], "quota")
    wanted = F.least(F.col("quota") * block, MOST * F.col("words"))
    shards = shards.select("source_no", "shard", "words", wanted.alias("wanted"))

    in_shard = Window.partitionBy("source_no", "shard").orderBy("digest", "doc_id", "size")
    dealt = dealt.withColumn(
        "before", F.coalesce(F.sum("size").over(in_shard.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    chosen = dealt.join(shards, ["source_no", "shard"])
    rounds = F.when(F.col("words") > 0, F.floor(F.col("wanted") / F.col("words"))).otherwise(0)
    rest = F.col("wanted") - rounds * F.col("words") - F.col("before")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return chosen.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "part")


def mixed(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """The documents of the mix with all columns of ``docs``: one row for each time a document is taken.

    A document that the end of a quota cuts is taken if at least half of its words are; rows equal in id and
    text are each taken as often as they are on average.
    """
    chosen = _taken(docs, block, shard_words, seed).where("taken > 0")
    times = F.floor(F.avg(F.col("taken") / F.col("size")) + 0.5).cast("int")
    chosen = chosen.groupBy(F.col("doc_id").alias("chosen_id"), "part").agg(times.alias("times")).where("times > 0")
    rows = packed(docs)
    rows = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.xxhash64("text") == F.col("part")))
    return unpacked(docs, rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))))
