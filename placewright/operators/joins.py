"""Joins of distinct mention texts with distinct gazetteer terms.

Each function takes ``texts(text)`` and ``dictionary(term)``, both without duplicates, and returns
``pairs(text, term, distance)``. None compares all texts with all terms: a similarity condition is
turned into an equality on derived keys that every matching pair is sure to share, and the pairs that
meet on a key are then verified. Keys are 64-bit hashes; a collision is caught by the verification.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.matching import byte_view, edit_distance, is_ascii, is_subsequence
from placewright.scratch import written

# Deletion keys per term up to which they are preferred to segment keys.
MAX_DELETION_KEYS = 2048
# Terms per segment key beyond which the key counts as hot.
HOT_KEY_TERMS = 4096
# Terms under a key, and texts that ask for it, up to which they are compared without asking for another byte pair
# (to ask costs about as many rows per term as the term has pairs), and pairs that are asked for at most.
FEW_TERMS, FEW_TEXTS, MAX_PAIRS = 64, 256, 8
# Keys, of some bytes each, that are broadcast after they have been counted.
MAX_BROADCAST_KEYS = 1_000_000
# Bits of a deletion key that hold the number of deletions, cut off at the largest value they can hold.
LEVEL_MASK = 15
# Prefix lengths whose keys are spread over several tasks, and over how many.
SHORT_PREFIX, SHORT_PREFIX_SALTS = 3, 16


def spread(strings: DataFrame) -> DataFrame:
    """Strings over all shuffle partitions, before each is turned into many keys.

    Partitions sized by the bytes of the strings would leave few tasks to make the keys. Given by
    number, the partitions are not merged again at run time; hashed by something else than the string,
    they are not taken for those that a distinct has left.
    """
    n_partitions = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return strings.repartition(n_partitions, F.xxhash64(strings.columns[0]))


def on_keys(keyed_texts: DataFrame, keyed_terms: DataFrame, keys: list[str]) -> DataFrame:
    """Join of two sides that were turned into many keys per string.

    Size estimates do not see how many, and might broadcast a side that is hundreds of times larger
    than they say. The hint keeps it a shuffle join, which skewed partitions are split in.
    """
    return keyed_texts.join(keyed_terms.hint("merge"), keys)


def exact_pairs(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Equal strings."""
    return texts.join(dictionary, F.col("text") == F.col("term")).withColumn("distance", F.lit(0))


# --- prefixes -------------------------------------------------------------------------------------


def prefix_lengths(texts: DataFrame, longest_term: int) -> Column:
    """The lengths that texts have, as an array for use in another query.

    Evaluated by one aggregation before the query that uses it. Texts longer than all terms do not
    count, so its size is bounded by the longest term, whatever the texts.
    """
    lengths = F.collect_set(F.when(F.length("text") <= longest_term, F.length("text")))
    return texts.agg(F.coalesce(lengths, F.array().cast("array<int>"))).scalar()


def with_prefixes(terms: DataFrame, lengths: Column, max_distance: int = 0) -> DataFrame:
    """One row per term and prefix length ``plen`` that some text has; the distance is what is left."""
    shortest = F.length("term") - max_distance if max_distance else F.lit(0)
    own = F.sequence(F.greatest(F.lit(0), shortest), F.length("term"))
    return terms.withColumn("plen", F.explode(F.array_intersect(own, lengths))).withColumn(
        "distance", F.length("term") - F.col("plen")
    )


def prefix_pairs(
    texts: DataFrame, dictionary: DataFrame, max_distance: int, longest_term: int
) -> DataFrame:
    """Terms that start with the text, at most ``max_distance`` longer unless that is 0.

    Terms emit one key per prefix, so pairs that meet are results: the join does no more work than
    its output asks for. Keys of short prefixes hold large parts of the dictionary and are salted;
    there are few texts that short to be repeated.
    """
    terms = with_prefixes(dictionary, prefix_lengths(texts, longest_term), max_distance)
    n_salts = lambda length: F.when(length <= SHORT_PREFIX, SHORT_PREFIX_SALTS).otherwise(1)
    terms = terms.select(
        "term",
        "distance",
        F.xxhash64(F.substring("term", F.lit(1), F.col("plen"))).alias("key"),
        F.pmod(F.xxhash64("term"), n_salts(F.col("plen"))).cast("int").alias("salt"),
    )
    salts = F.sequence(F.lit(0), n_salts(F.length("text")) - 1)
    keyed = texts.select("text", F.xxhash64("text").alias("key"), F.explode(salts).alias("salt"))
    met = on_keys(keyed, terms, ["key", "salt"]).filter(F.startswith("term", "text"))
    return met.select("text", "term", "distance")


# --- edit distance --------------------------------------------------------------------------------


# Kinds of deletion keys: both may have lost up to k characters, but only one of them all k; see deletion_keys.
FEWER_IN_TEXT, ALL_IN_TEXT, ALL_IN_BOTH = 1, 2, 3


def deletion_keys(text: Column, deletions: int, of_term: bool) -> Column:
    """Hashes of the string and of all strings left by deleting up to that many code points.

    Where text and term have both lost all k characters, they are within k edits only if each edit put one
    character in the place of another, so the same places must be gone from both; these keys hash the
    places as well. Otherwise codes built alike would meet all neighbours at twice the distance. A string
    that has lost fewer meets one that has lost all under a key of its own kind, without places.

    The lowest bits of a hash give way to the number of deletions; see :func:`key_of`.
    """

    def key(kind: int, level: int, string: Column, *places: Column) -> Column:
        hashed = F.xxhash64(F.lit(kind), string, *places)
        return hashed.bitwiseAND(F.lit(~LEVEL_MASK)).bitwiseOR(F.lit(min(level, LEVEL_MASK)))

    def keys(level: int, string: Column, places: list[Column]) -> Column:
        if level == deletions and level:
            plain = FEWER_IN_TEXT if of_term else ALL_IN_TEXT
            return F.array(key(plain, level, string), key(ALL_IN_BOTH, level, string, *places))
        kinds = [FEWER_IN_TEXT, ALL_IN_TEXT] if of_term and deletions else [FEWER_IN_TEXT]
        return F.array(*[key(kind, level, string) for kind in kinds])

    def without(string: Column, position: Column) -> Column:
        head = F.substring(string, F.lit(1), position - 1)
        return F.concat(head, F.substring(string, position + 1, F.length(string)))

    def shorter(string: Column, start: Column, places: list[Column]) -> Column:
        # Positions never move back, so that each set of deleted positions occurs once.
        positions = F.sequence(start, F.length(string))

        def at_position(at: Column) -> Column:
            # The array of one binds the shortened string to a name, to compute it once.
            rest = F.array(without(string, at))
            return F.flatten(F.transform(rest, lambda s: with_own(s, at, [*places, at])))

        found = F.flatten(F.transform(positions, at_position))
        return F.when(start <= F.length(string), found).otherwise(F.array().cast("array<bigint>"))

    def with_own(string: Column, start: Column, places: list[Column]) -> Column:
        own = keys(len(places), string, places)
        return own if len(places) == deletions else F.concat(own, shorter(string, start, places))

    return F.array_distinct(with_own(text, F.lit(1), []))


def keyed_terms(dictionary: DataFrame, k: int) -> DataFrame:
    """``key``, ``term`` and ``n``, the deletions that led to the key, for texts within ``k`` edits."""
    marked = spread(dictionary).select("term", F.explode(deletion_keys(F.col("term"), k, True)).alias("marked"))
    return marked.select(key_of(F.col("marked")).alias("key"), "term", level_of(F.col("marked")).alias("n"))


def key_of(marked: Column) -> Column:
    return marked.bitwiseAND(F.lit(~LEVEL_MASK))


def level_of(marked: Column) -> Column:
    return marked.bitwiseAND(F.lit(LEVEL_MASK)).cast("int")


def longest_for_deletions(k: int) -> int:
    """Length up to which terms get deletion keys for distance ``k``."""
    length = k
    while sum(math.comb(length + 1, i) for i in range(k + 1)) <= MAX_DELETION_KEYS:
        length += 1
    return length


def _deletion_candidates(
    texts: DataFrame, dictionary: DataFrame, k: int, as_subsequence: bool, keys: DataFrame | None = None
) -> DataFrame:
    """Pairs with a common string reachable by at most ``k`` deletions from either side.

    Two strings within distance k always have one. As both sides are without duplicates, a key is
    shared by no more terms than there are ways to insert k characters, so there are no hot keys, no
    matter how many places or mentions share a name. Strings of one length that meet after k deletions
    each differ in the deleted places only, so among codes of one form hardly any pair meets in vain.

    ``deleted`` is the larger number of deletions that led to the common string. Strings at distance d
    have one with at most d, so all others only repeat the pair.
    """
    text_keys = deletion_keys(F.col("text"), k, False)
    if as_subsequence:
        # An ASCII text inside a term is what deletions from the term alone lead to.
        text_keys = F.when(is_ascii(F.col("text")), deletion_keys(F.col("text"), 0, False)).otherwise(text_keys)
    keyed_texts = spread(texts).select("text", F.explode(text_keys).alias("marked"))
    keyed_texts = keyed_texts.select("text", key_of(F.col("marked")).alias("key"))
    met = on_keys(keyed_texts, keyed_terms(dictionary, k) if keys is None else keys, ["key"])
    # Both have lost characters down to the same length.
    from_text = F.col("n") - F.length("term") + F.length("text")
    return met.select("text", "term", F.greatest("n", from_text).alias("deleted"))


def _segment_keys_of_term(k: int) -> Column:
    """Hashes of the k + 1 segments that a term is cut into, with its length and their number."""
    term, length = F.col("term"), F.length("term")
    return F.array(
        *[
            F.xxhash64(length, F.lit(i), F.substring(term, start, size))
            for i in range(k + 1)
            for start, size in [_segment(length, i, k)]
        ]
    )


def _segment(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment ``i`` of ``k + 1``; the last ones take the remainder."""
    base = F.floor(length / (k + 1)).cast("int")
    longer = length % (k + 1)
    extra_before = F.greatest(F.lit(0), longer - (k + 1 - i))
    size = base + F.when(F.lit(i) >= k + 1 - longer, 1).otherwise(0)
    return base * i + extra_before + 1, size


def _segment_keys_of_text(k: int, longer_than: int) -> Column:
    """Hashes of all substrings of a text that may be a segment of a term within distance k."""

    text, shifts = F.col("text"), F.sequence(F.lit(-k), F.lit(k))

    def keys_of_segment(length: Column, i: int) -> Column:
        start, size = _segment(length, i, k)
        inside = F.filter(
            shifts, lambda d: (start + d >= 1) & (start + d + size - 1 <= F.length(text))
        )
        return F.transform(
            inside, lambda d: F.xxhash64(length, F.lit(i), F.substring(text, start + d, size))
        )

    def keys_for_length(length: Column) -> Column:
        return F.concat(*[keys_of_segment(length, i) for i in range(k + 1)])

    shortest = F.greatest(F.lit(longer_than + 1), F.length("text") - k)
    longest = F.length("text") + k
    lengths = F.sequence(shortest, longest)
    keys = F.array_distinct(F.flatten(F.transform(lengths, keys_for_length)))
    return F.when(shortest <= longest, keys).otherwise(F.array().cast("array<bigint>"))


def _segment_candidates(
    texts: DataFrame, dictionary: DataFrame, k: int, longer_than: int, as_subsequence: bool
) -> DataFrame:
    """Pairs of long strings with an equal segment at about the same place.

    k edits leave one of k + 1 segments intact. Where many terms share a segment, as names built from
    a template do, meeting on it would compare them all; texts and terms that touch such a segment
    meet on deletion keys instead. A pair that shares only hot segments is found there, any other pair
    on a segment that is not hot.
    """
    text_keys = F.explode(_segment_keys_of_text(k, longer_than))
    keyed_terms = spread(dictionary).select("term", F.explode(_segment_keys_of_term(k)).alias("key"))
    keyed_texts = spread(texts).select("text", text_keys.alias("key"))
    hot = keyed_terms.groupBy("key").count().filter(F.col("count") > HOT_KEY_TERMS).select("key")
    cold_pairs = on_keys(keyed_texts, keyed_terms.join(hot, "key", "left_anti"), ["key"])
    hot_terms = keyed_terms.join(hot, "key", "left_semi").select("term").distinct()
    hot_texts = keyed_texts.join(hot, "key", "left_semi").select("text").distinct()
    hot_pairs = _deletion_candidates(hot_texts, hot_terms, k, as_subsequence)
    return cold_pairs.select("text", "term", F.lit(0).alias("deleted")).unionByName(hot_pairs)


def _edit_candidates(
    texts: DataFrame,
    dictionary: DataFrame,
    k: int,
    longest_term: int | None,
    as_subsequence: bool = False,
    keys: DataFrame | None = None,
) -> DataFrame:
    limit = longest_for_deletions(k)
    if longest_term is not None and longest_term <= limit:
        return _deletion_candidates(texts, dictionary, k, as_subsequence, keys)
    short_texts = texts.filter(F.length("text") <= limit + k)
    short_terms = dictionary.filter(F.length("term") <= limit)
    long_terms = dictionary.filter(F.length("term") > limit)
    long_texts = texts.filter(F.length("text") > limit - k)
    return _deletion_candidates(short_texts, short_terms, k, as_subsequence, keys).unionByName(
        _segment_candidates(long_texts, long_terms, k, limit, as_subsequence)
    )


def levenshtein_pairs(
    texts: DataFrame, dictionary: DataFrame, k: int, longest_term: int | None = None, keys: DataFrame | None = None
) -> DataFrame:
    """Edit distance at most ``k``. A pair may come more than once; see :func:`once`.

    ``longest_term`` is the length of the longest term, if known; it saves the plan for long terms.
    ``keys`` are the keys of all terms that are short enough for them, as :func:`keyed_terms` makes them.
    """
    if k == 0:
        return exact_pairs(texts, dictionary)
    met = _edit_candidates(texts, dictionary, k, longest_term, keys=keys)
    distance = edit_distance(F.col("text"), F.col("term"), k)
    return met.withColumn("distance", distance).filter("distance >= deleted").drop("deleted")


def once(pairs: DataFrame) -> DataFrame:
    """Pairs without repetitions."""
    return pairs.dropDuplicates(["text", "term"])


# --- subsequences ---------------------------------------------------------------------------------


def capped_subsequence_pairs(
    texts: DataFrame, dictionary: DataFrame, k: int, longest_term: int | None = None, keys: DataFrame | None = None
) -> DataFrame:
    """Texts that are a byte subsequence of a term at edit distance 1..k. Pairs may repeat."""
    met = _edit_candidates(texts, dictionary, k, longest_term, as_subsequence=True, keys=keys)
    text, term = F.col("text"), F.col("term")
    within = met.withColumn("distance", edit_distance(text, term, k)).filter("distance >= deleted")
    # For an ASCII text the distance itself tells: only insertions make it the length difference.
    ascii_test = F.col("distance") == F.length(term) - F.length(text)
    test = F.when(is_ascii(text), ascii_test).otherwise(is_subsequence(text, term))
    return within.filter(test).drop("deleted")


def _with_bytes(strings: DataFrame, name: str) -> DataFrame:
    """Add the bytes of a string as an array, and as a ``mask`` with a bit for each byte modulo 64."""
    # Splitting the empty string gives one empty part.
    parts = F.array_remove(F.split(byte_view(F.col(name)), ""), "")
    split = spread(strings).withColumn("chars", parts)
    bit = lambda char: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(char) % 64)
    mask = F.aggregate("chars", F.lit(0).cast("long"), lambda bits, char: bits.bitwiseOR(bit(char)))
    return split.withColumn("mask", mask)


def _after(chars: Column, char: Column) -> Column:
    """What follows the first occurrence of a byte."""
    return F.slice(chars, F.array_position(chars, char).cast("int") + 1, F.size(chars))


def _pairs_of(chars: Column) -> Column:
    """The distinct pairs of bytes that occur in this order.

    Whatever follows a byte at all follows its first occurrence. So the work and the result grow with
    the number of different bytes, and not with the square of the length.
    """
    return F.flatten(
        F.transform(
            F.array_distinct(chars),
            lambda a: F.transform(F.array_distinct(_after(chars, a)), lambda b: F.concat(a, b)),
        )
    )


def _grams(chars: Column) -> Column:
    """The pairs of bytes that occur in this order, the bytes, and the empty gram."""
    return F.concat(F.array(F.lit("")), F.array_distinct(chars), _pairs_of(chars))


def gram_counts(dictionary: DataFrame) -> DataFrame:
    """How many terms have each gram, as a table of bounded size that is written at once."""
    grams = _grams_of(_with_bytes(dictionary, "term").withColumnRenamed("mask", "term_mask"))
    return written(grams.groupBy("gram").agg(F.count("*").alias("n_terms")))


def subsequence_pairs(
    texts: DataFrame, dictionary: DataFrame, counts: DataFrame | None = None
) -> DataFrame:
    """Texts that are a byte subsequence of a term, at any distance.

    Every two bytes of the text occur in this order in the term. So a text looks for its terms under the byte pair
    that the fewest terms have. Where these are more than a few, and many texts share the pair, it asks for its next
    rarest pair as well, and so on: terms under a hot key go on to the longer keys that texts ask for, and are counted there, until a key
    holds few terms or all pairs of the text are in it, and terms under it are as good as results. So candidates
    grow with terms under keys (each meets ``FEW_TEXTS`` texts at most) and results, not with the product of the
    texts and terms that share a pair.

    The counts of bytes and pairs have at most 256 * 256 + 256 + 1 rows whatever the data. What is known of a step is
    written to tables, so that the plan for the rest follows measured sizes. ``counts`` may come from a
    larger dictionary: it guides the choices, but any choice finds all pairs.
    """
    term_bytes = _with_bytes(dictionary, "term").withColumnRenamed("mask", "term_mask")
    counts = gram_counts(dictionary) if counts is None else counts
    asked = written(_choices(texts, counts))
    first = F.broadcast(asked.select("key").distinct())  # grams, see above
    keyed = _grams_of(term_bytes).withColumnRenamed("gram", "key").join(first, "key", "left_semi")
    met = []
    for step in range(1, MAX_PAIRS + 1):
        sharing = asked.groupBy("key").agg(F.count("*").alias("n_texts"))
        asked = asked.join(sharing, "key")
        few = (F.col("n_terms") <= FEW_TERMS) | (F.col("n_texts") <= FEW_TEXTS)
        done = few | (F.size("grams") <= step) | F.lit(step == MAX_PAIRS)
        met.append(on_keys(asked.filter(done).select("text", "mask", "key"), keyed, ["key"]).drop("key"))
        rest = written(asked.filter(~done).withColumn("gram", F.get("grams", F.lit(step))))
        wanted = written(rest.select("key", "gram").distinct())
        n_wanted = wanted.count()
        if not n_wanted:
            break
        keyed = written(_with_next_pair(keyed, wanted, n_wanted))
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n_terms"))
        # a longer key that no term has leaves its texts without terms
        rest = rest.withColumn("key", _longer_key()).drop("n_terms", "n_texts", "gram")
        asked = written(rest.join(sizes, "key"))
    pairs = met[0]
    for more in met[1:]:
        pairs = pairs.unionByName(more)
    # The cheap tests first, as most pairs fail them.
    text, term = F.col("text"), F.col("term")
    contained = F.col("mask").bitwiseAND(F.bitwise_not("term_mask")) == 0
    pairs = pairs.filter(contained & (F.octet_length(text) < F.octet_length(term)))
    gap = F.length(term) - F.length(text)
    # One distance answers both questions for ASCII texts; others need the bytes compared as well.
    inserted = F.call_function("levenshtein", text, term, F.greatest(gap, F.lit(0)))
    distance = F.when(is_ascii(text), F.when((gap >= 0) & (inserted >= 0), gap)).when(
        is_subsequence(text, term), edit_distance(text, term)
    )
    longer = pairs.select("text", "term", distance.alias("distance")).filter(F.col("distance").isNotNull())
    # Strings of equal size contain each other only if they are equal.
    return longer.unionByName(exact_pairs(texts, dictionary))


def _grams_of(term_bytes: DataFrame) -> DataFrame:
    return term_bytes.select("term", "term_mask", F.explode(_grams(F.col("chars"))).alias("gram"))


def _longer_key() -> Column:
    return F.concat("key", "gram")


def _choices(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """Each text's pairs of bytes from the rarest on, the key of the rarest, and the number of terms under it.

    Texts with a pair that no term has are left out.
    """
    # A text of one byte has no pair and an empty one no byte: they have to take what they have.
    own_size = F.least(F.lit(2), F.octet_length("text"))
    own = F.filter(_grams(F.col("chars")), lambda gram: F.length(gram) == own_size)
    grams = _with_bytes(texts, "text").select("text", "mask", F.explode(own).alias("gram"))
    counted = grams.join(F.broadcast(counts), "gram", "left")
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("n_terms", F.lit(0)).alias("n_terms"), "gram")))
    chosen = counted.groupBy("text").agg(F.first("mask").alias("mask"), ordered.alias("ordered"))
    rarest = F.transform(F.slice("ordered", 1, MAX_PAIRS), lambda s: s["gram"])
    chosen = chosen.select("text", "mask", F.col("ordered")[0]["n_terms"].alias("n_terms"), rarest.alias("grams"))
    return chosen.filter("n_terms > 0").withColumn("key", F.col("grams")[0])


def _with_next_pair(keyed: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """Terms under the longer keys that texts ask for: those that have the next pair as well."""
    if n_wanted <= MAX_BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    hot = keyed.join(wanted.select("key").distinct(), "key", "left_semi")
    pairs = _with_bytes(hot, "term").select("key", "term", "term_mask", F.explode(_grams(F.col("chars"))).alias("gram"))
    return pairs.join(wanted, ["key", "gram"]).select("term", "term_mask", _longer_key().alias("key"))
