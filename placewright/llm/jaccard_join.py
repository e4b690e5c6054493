"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct shingles of ``shingle`` lower-cased words (of all words, if fewer; ``SHINGLE`` by default).
Two documents link when their sets are at least ``percent`` % alike (``PERCENT`` by default); ``components`` of links are returned.

1. Equal sets are one vertex, from an aggregate over 128-bit hashes of sets.
2. Similar vertices are compared with one leader, the set with most copies, among those with the same least shingle (in a
   random order), in two rounds with different orders. What links is one component from then on, and its
   members are not compared with each other.
3. Similar vertices are partitioned into groups: a large component is one, others are those with the same two least shingles.
   The token-group matrix has a row for each shingle of a prefix and each group that holds it in a
   member's prefix. If two sets link, their prefixes (the first ``n - ceil(n * percent / 100) + l`` shingles in
   one global order, rare ones first) share at least ``l``, so groups whose rows share fewer are
   not opened. Only pairs of groups are counted, however many members they have.
4. Groups that qualify are opened block by block (members of about ``BLOCK`` shingles): a set whose overlap with the token union of
   a block is below what any member would need skips it; others are compared with its members, exactly, until
   all of them are in one component.

Nothing is dropped: the order only decides the work. It takes frequent shingles from a bounded sample of
documents. Texts are shuffled only for vertices that share a key or a qualifying group.

Defined cases: a null or blank text has no set and links with nothing, not even its like; rows with the same ``doc_id``
count as linked; a null ``doc_id`` counts as the least one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.components import components
from placewright.llm.tables import packed, shipped, unpacked
from placewright.llm.words import WordHashes, mixed
from placewright.scratch import written

SHINGLE, PERCENT = 4, 85
#: Documents whose shingles are counted to know the frequent ones, and how many of these are kept at most.
SAMPLE_ROWS, FREQUENT, FREQUENT_FROM = 12_000, 300_000, 2
#: Vertices of a component from which on it is a group by itself, and shingles of the members that are opened together.
LARGE, BLOCK = 32, 1 << 16
#: Blocks that are compared with one opened block in one go.
PARTNERS = 128
#: Shared prefix shingles that are asked for, per set size (one at least).
ASKED = 0.05
#: Tables of ids are broadcast up to this number of rows (16 bytes each), and shuffled beyond it.
BROADCAST_ROWS = 1_000_000
LEAST_ID = -(1 << 63)
#: The highest bit of a token's place in the global order: set for frequent shingles.
LAST = np.uint64(1 << 63)


class Shingles:
    """Sets of 64-bit shingle hashes, sorted."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size, self.words = size, WordHashes()

    def sets(self, texts: list[str]) -> Iterator[np.ndarray]:
        # bytes are lower-cased and split in ASCII alone, which is what the words are made of
        for hashes in self.words(texts):
            size = min(self.size, len(hashes))
            n = len(hashes) - size + 1 if size else 0
            total = np.full(n, size, np.uint64)
            for i in range(size):
                total = (total ^ (total >> np.uint64(33))) * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
            total = np.sort(mixed(total))
            yield total[np.append(True, total[1:] != total[:-1])] if n else total


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    places = np.searchsorted(large, small)
    places[places == len(large)] = 0
    both = int((large[places] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def places(shingles: np.ndarray, frequent: np.ndarray, salt: int = 0) -> np.ndarray:
    """The place of each shingle in the global order: rare ones first, then by a salted hash.

    Places stand for their shingles: hashing is a permutation, and of two shingles with one place (which differ
    in the bit that tells frequent ones) the worst is a candidate too many.
    """
    place = mixed(shingles, salt) & ~LAST
    if len(frequent) and len(shingles):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        place[frequent[at] == shingles] |= LAST
    return place


def asked(n: int) -> int:
    return max(1, int(ASKED * n))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    least = -(-percent * n // 100)
    return min(n, n - least + asked(n))


def _rows(docs: DataFrame) -> DataFrame:
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))
    return docs.select(ids.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _small(table: DataFrame) -> DataFrame:
    table = written(table)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def frequent_shingles(rows: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """Hashes that several documents of a bounded sample share, most frequent first, at most ``FREQUENT``."""
    step = max(1, -(-rows.count() // SAMPLE_ROWS))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Shingles(size)
        for batch in batches:
            sets = list(make.sets(batch["text"].tolist()))
            yield pd.DataFrame({"shingle": np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)})

    counts = sample.mapInPandas(shingles, "shingle long").groupBy("shingle").count().where(F.col("count") >= FREQUENT_FROM)
    found = counts.orderBy(F.col("count").desc(), "shingle").limit(FREQUENT).toPandas()["shingle"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def summaries(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """For every row: ``n`` shingles, hashes ``s1``, ``s2`` of the set, and its least shingles in two random orders."""

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(size)
        for batch in batches:
            n, s1, s2, k1, k2 = [], [], [], [], []
            for shingles in make.sets(batch.column("text").to_pylist()):
                n.append(len(shingles))
                digest = xxhash.xxh128_intdigest(shingles.tobytes())
                s1.append((digest >> 64) - (1 << 63))
                s2.append((digest & (1 << 64) - 1) - (1 << 63))
                for keys, salt in ((k1, 0), (k2, 77)):
                    # not the rarest first: what a near copy alone has would then be its key
                    keys.append(int(mixed(shingles, salt).min()) - (1 << 63) if len(shingles) else None)
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, s1, s2, k1, k2))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "s1", "s2", "k1", "k2"])

    return rows.mapInArrow(summarised, "doc_id long, n long, s1 long, s2 long, k1 long, k2 long")


def _stars(rows: DataFrame, vertices: DataFrame, key: str, size: int, percent: int) -> DataFrame:
    """Edges of vertices to the leader of those with the same ``key``, where they link."""
    keyed = vertices.select("vertex", F.col(key).alias("key"), "copies")
    leaders = keyed.groupBy("key").agg(F.max(F.struct("copies", F.bitwise_not("vertex").alias("least"))).alias("m"), F.count("*").alias("size"))
    leaders = leaders.where("size > 1").select("key", F.bitwise_not("m.least").alias("leader"))
    wanted = _small(keyed.join(leaders, "key").select(F.col("vertex").alias("doc_id"), "key", "leader"))
    members = rows.join(wanted, "doc_id")
    first = members.where("doc_id = leader").select("key", F.col("text").alias("leading")).dropDuplicates(["key"])
    pairs = members.where("doc_id <> leader").join(first, "key").select("doc_id", "leader", "text", "leading")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, lead, last, leading = Shingles(size), Shingles(size), None, None
        for batch in batches:
            links = []
            leaders, texts = batch.column("leader").to_pylist(), batch.column("text").to_pylist()
            for row, (leader, own) in enumerate(zip(leaders, make.sets(texts), strict=True)):
                if leader != last:
                    last, leading = leader, next(lead.sets([batch.column("leading")[row].as_py()]))
                links.append(linked(own, leading, percent))
            kept = pa.array(links, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(kept), batch.column("leader").filter(kept)], names=["a", "b"])

    return written(pairs.mapInArrow(compared, "a long, b long").distinct())


def _grouped(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vertices`` with ``group``, the least vertex that edges reach."""
    found = components(edges).withColumnRenamed("vertex", "_v").withColumnRenamed("component", "_c")
    joined = vertices.drop("group").join(found, F.col("vertex") == F.col("_v"), "left")
    return written(joined.withColumn("group", F.coalesce("_c", "vertex")).drop("_v", "_c"))


def _partitioned(vertices: DataFrame) -> DataFrame:
    """Groups of similar vertices: ``vertex``, its component so far ``known``, ``group``, ``block``, and the sizes in the group.

    A component of at least ``LARGE`` vertices is a group. All other vertices are grouped by their least
    shingles in two orders, whether they link or not. The least vertex of a group is its name.
    """
    sizes = vertices.groupBy("group").agg(F.count("*").alias("n"))
    known = vertices.join(sizes, "group").withColumnRenamed("group", "known").withColumn("large", F.col("n") >= LARGE)
    key = F.when(F.col("large"), F.struct(F.lit(None).cast("long").alias("k1"), F.col("known").alias("k2"))).otherwise(F.struct("k1", "k2"))
    known = known.withColumn("key", key)
    groups = known.groupBy("key").agg(
        F.min("vertex").alias("group"), F.min("least").alias("g_least"), F.max("most").alias("g_most"), F.count("*").alias("members"), F.sum("most").alias("shingles")
    )
    block = F.pmod(F.xxhash64("vertex"), F.ceil(F.col("shingles") / BLOCK)).cast("int")
    return written(known.join(groups, "key").select("vertex", "known", "large", "group", "members", "g_least", "g_most", block.alias("block")))


MATRIX = "token long, group long, least int, most int"


def _matrix(rows: DataFrame, partitioned: DataFrame, frequent, size: int, percent: int) -> DataFrame:
    """The token-group matrix: ``token`` and ``group`` for the prefixes of all vertices, and the sizes in the group."""
    # vertices that are a group of their own are not looked up
    grouped = partitioned.where("members > 1").select(F.col("vertex").alias("doc_id"), "group", "g_least", "g_most")
    rows = rows.join(_small(grouped), "doc_id", "left").select(F.coalesce("group", "doc_id").alias("group"), "g_least", "g_most", "text")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, often = Shingles(size), frequent()
        for batch in batches:
            prefixes, n = [], []
            for shingles in make.sets(batch.column("text").to_pylist()):
                n.append(len(shingles))
                length = prefix_length(n[-1], percent)
                place = places(shingles, often)
                prefixes.append(np.partition(place, length - 1)[:length] if length < n[-1] else place)
            lengths = [len(p) for p in prefixes]
            if not sum(lengths):
                continue
            sizes = [np.array([s if g is None else g for s, g in zip(n, batch.column(c).to_pylist(), strict=True)], np.int32) for c in ("g_least", "g_most")]
            columns = [pa.array(np.concatenate(prefixes).view(np.int64)), *(pa.array(np.repeat(v, lengths)) for v in (batch.column("group").to_numpy(), *sizes))]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "group", "least", "most"])

    return rows.mapInArrow(tokens, MATRIX)


def qualifying_groups(matrix: DataFrame, partitioned: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs ``a`` and ``b`` of groups whose rows of the matrix share enough tokens, and groups to compare within."""
    matrix = matrix.distinct()
    other = matrix.select("token", F.col("group").alias("other"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    alike = (100 * F.col("most") >= percent * F.col("least2")) & (100 * F.col("most2") >= percent * F.col("least"))
    pairs = matrix.join(other, "token").where((F.col("group") < F.col("other")) & alike)
    pairs = pairs.groupBy("group", "other").agg(F.count("*").alias("both"), F.min(F.least("least", "least2")).alias("n"))
    pairs = pairs.where(F.col("both") >= F.greatest(F.lit(1), F.floor(ASKED * F.col("n")))).select(F.col("group").alias("a"), F.col("other").alias("b"))
    within = partitioned.where("members > 1 and not large").select(F.col("group").alias("a"), F.col("group").alias("b")).distinct()
    return written(pairs.union(within))


class Forest:
    """Components that grow as links are found; each link that joins two of them is kept."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        self.above[self.root(x)] = self.root(y)


def _links(block: list, union: np.ndarray, least: int, partners: list, percent: int) -> Iterator[tuple[int, int]]:
    """Links between members (vertex, component so far, set) of a block and others that join two components."""
    forest = Forest()
    for vertex, known, own in partners:
        # what a member of the block would have to share with this set
        needed = percent * (len(own) + max(least, -(-percent * len(own) // 100))) / (100 + percent)
        if np.isin(own, union, assume_unique=True).sum() < needed:
            continue
        for other, other_known, other_set in block:
            if forest.root(known) != forest.root(other_known) and linked(own, other_set, percent):
                forest.join(known, other_known)
                yield vertex, other


def _links_within(block: list, percent: int) -> Iterator[tuple[int, int]]:
    forest = Forest()
    for i, (vertex, known, own) in enumerate(block):
        for other, other_known, other_set in block[:i]:
            if forest.root(known) != forest.root(other_known) and linked(own, other_set, percent):
                forest.join(known, other_known)
                yield vertex, other


def opened(rows: DataFrame, partitioned: DataFrame, pairs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Edges between vertices of the groups of ``pairs`` that link and were not in one component.

    A block of the larger group is opened once for up to ``PARTNERS`` blocks of others, which stream past it.
    """
    sizes = partitioned.groupBy("group").agg(F.count("*").alias("n"))
    blocks = partitioned.select("group", "block").distinct()
    met = pairs.join(sizes.select(F.col("group").alias("a"), F.col("n").alias("n1")), "a").join(sizes.select(F.col("group").alias("b"), F.col("n").alias("n2")), "b")
    larger = F.col("n1") > F.col("n2")
    met = met.select(F.when(larger, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(larger, F.col("a")).otherwise(F.col("b")).alias("b"))
    one = blocks.select(F.col("group").alias("a"), F.col("block").alias("i"))
    two = blocks.select(F.col("group").alias("b"), F.col("block").alias("j"))
    met = written(met.join(one, "a").join(two, "b").where("a <> b or i <= j"))

    within = met.where("a = b and i = j").select(F.col("b").alias("group"), F.col("j").alias("block"), F.lit(True).alias("within"))
    met = met.where("a <> b or i <> j")
    shares = met.groupBy("b", "j").agg(F.ceil(F.count("*") / PARTNERS).alias("shares"))
    met = met.join(shares, ["b", "j"]).withColumn("share", F.pmod(F.xxhash64("a", "i"), F.col("shares")).cast("int"))
    met = met.select("a", "i", "b", "j", "share")
    open_ = met.select(F.col("b").alias("group"), F.col("j").alias("block"), "share").distinct()
    open_ = open_.join(within, ["group", "block"], "full").select("group", "block", F.coalesce("share", F.lit(0)).alias("share"), F.coalesce("within", F.lit(False)).alias("within"))
    open_ = written(open_.withColumn("within", F.col("within") & (F.row_number().over(Window.partitionBy("group", "block").orderBy("share")) == 1)))

    used = open_.select("group", "block").union(met.select(F.col("a").alias("group"), F.col("i").alias("block"))).distinct()
    members = partitioned.join(used, ["group", "block"]).select("vertex", "known", "group", "block")
    texts = rows.join(_small(members.withColumnRenamed("vertex", "doc_id")), "doc_id")
    members = F.collect_list(F.struct("doc_id", "known", "text")).alias("members")
    filled = written(texts.groupBy("group", "block").agg(members))
    opening = open_.join(filled, ["group", "block"]).select("group", "block", "share", F.lit(0).alias("kind"), "within", "members")
    own = filled.withColumnRenamed("group", "a").withColumnRenamed("block", "i")
    passing = met.join(own, ["a", "i"]).select(F.col("b").alias("group"), F.col("j").alias("block"), "share", F.lit(1).alias("kind"), F.lit(False).alias("within"), "members")
    stream = opening.union(passing).repartition("group", "block", "share").sortWithinPartitions("group", "block", "share", "kind")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(size)
        block, union, least = [], np.zeros(0, np.uint64), 0
        for batch in batches:
            found = []
            for row, (kind, inner) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("within").to_pylist(), strict=True)):
                given = batch.column("members")[row].values
                fields = [given.field(c).to_pylist() for c in ("doc_id", "known", "text")]
                sets = list(zip(fields[0], fields[1], make.sets(fields[2]), strict=True))
                if kind:
                    found.extend(_links(block, union, least, sets, percent))
                    continue
                block, least = sets, min(len(s[2]) for s in sets)
                union = sets[0][2] if len(sets) == 1 else np.unique(np.concatenate([s[2] for s in sets]))
                if inner:
                    found.extend(_links_within(block, percent))
            edges = np.array(found, np.int64).reshape(len(found), 2)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    return stream.mapInArrow(compared, "a long, b long").distinct()


def join_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row of ``docs``."""
    rows = _rows(docs)
    frequent = shipped(docs.sparkSession, frequent_shingles(rows, shingle))
    seen = written(summaries(rows, shingle))
    least = [F.min(c).alias(c) for c in ("n", "k1", "k2")]
    sets = written(seen.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("vertex"), *least, F.count("*").alias("copies")))
    # rows of one doc_id are linked, and so are copies
    copies = seen.where("n > 0").join(sets.select("s1", "s2", "vertex"), ["s1", "s2"])
    copies = copies.where("doc_id <> vertex").select(F.col("doc_id").alias("a"), F.col("vertex").alias("b")).distinct()
    copies = written(copies)
    vertices = sets.groupBy("vertex").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("k1").alias("k1"), F.min("k2").alias("k2"), F.sum("copies").alias("copies")
    )
    spare = copies.select(F.col("a").alias("vertex")).distinct().join(vertices, "vertex", "left_anti")
    rows = rows.join(_small(spare.withColumnRenamed("vertex", "doc_id")), "doc_id", "left_anti")

    edges = _stars(rows, vertices, "k1", shingle, percent)
    vertices = _grouped(vertices, edges)
    leaders = vertices.where("vertex = group")
    edges = edges.union(_stars(rows, leaders, "k2", shingle, percent))
    vertices = _grouped(vertices, edges)
    partitioned = _partitioned(vertices)
    pairs = qualifying_groups(_matrix(rows, partitioned, frequent, shingle, percent), partitioned, percent)
    edges = edges.union(opened(rows, partitioned, pairs, shingle, percent)).union(vertices.select(F.col("vertex").alias("a"), F.col("group").alias("b")))
    found = components(edges.union(copies))
    found = seen.join(found, F.col("doc_id") == F.col("vertex"), "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    given = [F.when(c != LEAST_ID, c) for c in (F.col("doc_id"), component)]
    return found.select(given[0].alias("doc_id"), F.col("n").alias("n_shingles"), given[1].alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, or have no set; texts are shuffled once at most."""
    # rows of one doc_id are in one component, so ids tell which rows go
    found = join_documents(docs, shingle, percent).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone")).distinct()
    return unpacked(docs, packed(docs).join(_small(found), F.col("doc_id") == F.col("gone"), "left_anti"))
