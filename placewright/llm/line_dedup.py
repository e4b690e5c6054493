"""Line dedup: lines that repeat an earlier line up to one edit of a word.

Lines are compared as sequences of words. A line is removed if an earlier line (by ``doc_id``, then
number) is equal, or if both have at least ``MIN_WORDS`` words and differ by one inserted, deleted or
replaced word, so that near-equal lines are at least 0.8 alike. The earliest line stays.

1. Equal lines become one row by a partial aggregate over two 64-bit hashes.
2. Two lines within one edit share either the front or the back half of the shorter one. Lines that
   share neither half with another line are done; this loses no pair.
3. The rest emits all its variants with one word deleted as hashed keys. They come from running XORs
   over the words, so a line costs its length, not its square.
4. A key's earliest line comes from an aggregate, and every line meets that one only, never all lines
   of the key: lines with the same deleted place are all within one edit of it. What meets is verified
   word by word.

Defined cases: a null text has no line; lines without words stay; a ``doc_id`` that is null is the
earliest; rows with the same ``doc_id`` are one document whose texts follow each other by hash; an
empty table gives an empty result. All of it are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.llm.tables import WORD, packed, unpacked, words
from placewright.scratch import written

#: Below it one edit is more than a fifth of a line.
MIN_WORDS = 5
#: Tables of ids and hashes are broadcast up to this number of rows (some 32 bytes each); beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Words whose hashes are chained in one piece.
CHAIN = 32
#: What ids that are null are taken for.
LEAST_ID = -(1 << 63)


def _exploded(docs: DataFrame) -> DataFrame:
    """One row per line with words: ``doc_id``, ``part`` (which of several rows with that id), ``line_no``, ``line``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("part"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(WORD))


def _half_keys(tokens: Column, n: Column) -> Column:
    """Hashes of the halves that a line within one edit shares, for either length of the shorter line."""
    keys = []
    for shorter in (n, n - 1):
        half = F.floor(shorter / 2).cast("int")
        keys.append(F.xxhash64(F.lit(1), shorter, F.slice(tokens, F.lit(1), half)))
        keys.append(F.xxhash64(F.lit(2), shorter, F.slice(tokens, n - half + 1, half)))
    return F.array(*keys)


def _small(table: DataFrame) -> DataFrame:
    """``table``, written; to be broadcast if it has few enough rows."""
    table = written(table)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def line_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All lines with words by hash, and a row for each class of equal lines with its earliest line.

    The ids ``lid`` of the classes are in the order of their earliest lines.
    """
    tokens = _exploded(docs).withColumn("words", words(F.col("line")))
    line, n = F.array_join("words", " "), F.size("words")
    keys = F.when(n >= MIN_WORDS, _half_keys(F.col("words"), n))
    tokens = tokens.select("doc_id", "part", "line_no", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), keys.alias("keys"))
    lines = written(tokens)
    classes = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "part", "line_no")).alias("place"), F.first("keys").alias("keys"))
    classes = classes.select("place.*", "h1", "h2", "keys").repartitionByRange("doc_id", "part", "line_no")
    classes = classes.sortWithinPartitions("doc_id", "part", "line_no").withColumn("lid", F.monotonically_increasing_id())
    return lines.drop("keys"), written(classes)


def _candidates(classes: DataFrame) -> DataFrame:
    """The classes that share a half with another class: ``lid`` and the place of the line."""
    keyed = classes.where("keys is not null").select("lid", "doc_id", "part", "line_no", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return keyed.join(_small(shared), "key").select("lid", "doc_id", "part", "line_no").distinct()


def _running_xor(values: Column) -> Column:
    """For each place of an array the XOR of what is before it, in pieces so that long arrays stay linear."""

    def appended(chain: Column, value: Column) -> Column:
        return F.concat(chain, F.array(F.element_at(chain, -1).bitwiseXOR(value)))

    starts = F.sequence(F.lit(1), F.size(values), F.lit(CHAIN))
    nothing = F.array(F.lit(0).cast("long"))
    pieces = F.transform(starts, lambda s: F.aggregate(F.slice(values, s, F.lit(CHAIN)), nothing, appended))
    before = F.aggregate(pieces, nothing, lambda chain, piece: appended(chain, F.element_at(piece, -1)))
    shifted = F.zip_with(
        pieces,
        F.slice(before, F.lit(1), F.size(pieces)),
        lambda piece, b: F.transform(F.slice(piece, F.lit(1), F.size(piece) - 1), lambda x: x.bitwiseXOR(b)),
    )
    return F.flatten(shifted)


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def _hashed(lines: DataFrame) -> DataFrame:
    """Lines with the hashes of their words at their own places, and one place further to the front."""
    here = F.transform("words", lambda w, i: F.xxhash64(w, i))
    there = F.transform("words", lambda w, i: F.xxhash64(w, i - 1))
    return lines.select("lid", F.size("words").alias("n"), here.alias("here"), there.alias("there"))


def _variants(lines: DataFrame) -> DataFrame:
    """A row for each word of each line: ``without``, the hash of the line without that word, and its place ``at``."""
    hashed = _hashed(lines)
    front, back = _running_xor(F.col("here")), _running_xor(F.col("there"))
    hashed = hashed.select("lid", "n", "there", front.alias("front"), back.alias("back"), _xor(F.col("there")).alias("all"))
    behind = F.zip_with("back", "there", lambda b, t: b.bitwiseXOR(t))
    without = F.zip_with("front", behind, lambda f, b: f.bitwiseXOR(b))
    return hashed.select("lid", "n", "all", F.posexplode(without).alias("at", "x")).select(
        "lid", "n", "at", F.col("x").bitwiseXOR(F.col("all")).alias("without")
    )


def _within_one_edit(a: Column, b: Column) -> Column:
    """Whether word sequences differ by one replaced, inserted or deleted word."""
    n, m = F.size(a), F.size(b)
    replaced = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: ~same)) <= 1

    def inserted(long: Column, short: Column) -> Column:
        size = F.size(short)
        same = F.zip_with(F.slice(long, F.lit(1), size), short, lambda x, y: x == y)
        differ = F.array_position(same, F.lit(False)).cast("int")
        front = F.when(differ == 0, size).otherwise(differ - 1)
        return F.slice(long, front + 2, size - front) == F.slice(short, front + 1, size - front)

    return F.when(n == m, replaced).when(n == m + 1, inserted(a, b)).when(m == n + 1, inserted(b, a)).otherwise(F.lit(False))


def near_lines(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``lid`` of the classes that repeat an earlier line up to an edit."""
    place = ["doc_id", "part", "line_no"]
    lines = _exploded(docs).join(_small(_candidates(classes)), place).select("lid", words(F.col("line")).alias("words"))
    # equal rows of the table hold the same line at the same place
    lines = written(lines.dropDuplicates(["lid"]))
    variants = written(_variants(lines))
    first = variants.groupBy("without", "n", "at").agg(F.min("lid").alias("other"), F.count("*").alias("lines"))
    replaced = variants.join(_small(first.where("lines > 1").drop("lines")), ["without", "n", "at"]).select("lid", "other")
    whole = _hashed(lines).select(_xor(F.col("here")).alias("without"), (F.col("n") + 1).alias("n"), F.col("lid").alias("other"))
    inserted = variants.join(_small(whole), ["without", "n"]).select("lid", "other")
    pairs = replaced.union(inserted).where("lid <> other")
    pairs = pairs.select(F.greatest("lid", "other").alias("lid"), F.least("lid", "other").alias("other")).distinct()
    left = lines.withColumnRenamed("words", "a")
    right = lines.select(F.col("lid").alias("other"), F.col("words").alias("b"))
    pairs = pairs.join(left, "lid").join(right, "other").where(_within_one_edit(F.col("a"), F.col("b")))
    return pairs.select("lid").distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``line_no`` and ``near`` (else equal) of all lines that go."""
    lines, classes = line_classes(docs)
    near = near_lines(docs, classes).withColumn("near", F.lit(True))
    place = F.struct("doc_id", "part", "line_no")
    classes = classes.join(near, "lid", "left").select("h1", "h2", place.alias("place"), F.coalesce("near", F.lit(False)).alias("near"))
    lines = lines.join(classes, ["h1", "h2"])
    return lines.where((place != F.col("place")) | F.col("near")).select("doc_id", "part", "line_no", "near")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (as a struct ``row``): ``doc_id``, the ``text`` that stays, and ``n_lines``, ``n_equal``, ``n_near``.

    The last two count the lines that went.
    """
    gone = removed_lines(docs).distinct().groupBy(F.col("doc_id").alias("id"), "part")
    gone = gone.agg(F.collect_list("line_no").alias("gone"), F.sum(F.col("near").cast("long")).alias("n_near"))
    text = F.coalesce("text", F.lit(""))
    same = (F.coalesce("doc_id", F.lit(LEAST_ID)) == F.col("id")) & (F.xxhash64(text) == F.col("part"))
    joined = packed(docs).join(gone, same, "left")

    def staying(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    # the array of one binds the lines to a name: within the inner function a text would be split anew for each of its lines
    kept = F.transform(F.array(F.split(text, "\n")), staying)[0]
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return joined.select(
        "row",
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        (n_gone - F.coalesce("n_near", F.lit(0))).cast("long").alias("n_equal"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def deduped(docs: DataFrame) -> DataFrame:
    """``docs`` with its lines deduplicated, ``n_chars`` counted anew; no document is dropped."""
    done = dedup_lines(docs)
    return unpacked(docs, done, text=F.col("text"), n_chars=F.length("text"))
