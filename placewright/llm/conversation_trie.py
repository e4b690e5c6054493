"""Prefix trie of conversations, some of which go on from the head of another.

1. Turns. Every conversation is a sequence of turns, in the order of ``turn`` (null first), then role and text.
   A turn stands for two pairs of affine maps ``x -> a x + b`` modulo a prime, made from hashes of role and text.
   Maps compose and composition is associative, so the fingerprint of a sequence is the product of its parts.
2. Grafts. A rebuilt conversation is the head of a base and its own turns after that head. Its text is never
   put together: products of the head's prefixes are taken from the base, products of the own suffix from
   its own turns, and the fingerprint of a depth is the one times the other.
3. Nodes. Prefixes of one depth and fingerprint are a node: members are counted by partial aggregates.
   Then equality is verified: the members of a node must share the fingerprint of the parent and the
   hash of the last turn, and turns of one hash must share role and text, which are looked at where the turns are
   stored. By induction over the depths, equal fingerprints are then equal sequences. Should a check
   fail, all is done again with other hashes.
4. Sums over subtrees need no walk down: a node's descendants are reached by the conversations that are their least
   members, and these are members of the node. So each conversation brings the sums of the nodes that it is the
   least member of, and what lies above the node is taken off again.

Products of long conversations are made in blocks, and blocks of blocks; sums run over pieces of depths; the ids that end
at a node are joined in pieces and hashed as they stream by. So neither a conversation with very many turns nor a
node with very many members is held by a task.

Defined cases: rows with a null ``conv_id`` take no part; null roles and texts are empty; equal rows are as many
turns; a conversation whose rebuilt form has no turn is a member of the root alone; a base that does not exist, or is
shorter than the head, gives what it has; an empty table has no node, not even a root. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.operators.ranking import with_rank
from placewright.scratch import written

#: Fixed value: the prime of the affine maps; products of two factors fit 63 bits.
MODULUS = (1 << 31) - 1
#: Turns whose products are made in one row, and depths that are summed in one window.
BLOCK, DEPTHS = 32, 1024
#: Ids of a node are joined to texts for so many neighbouring ids (as a power of two).
ID_BITS = 9
#: Lengths of the beginnings that borders of ranges are drawn from.
ROLE_BEGINNING, TEXT_BEGINNING = 16, 48

#: Rules of the registered query: groups of conversations that go on from their first, and lengths of heads.
GROUP, HEADS = 100, 6

NODE = ["depth", "f", "g"]
PARENT = ["parent_f", "parent_g"]


@dataclass
class Trie:
    """``nodes``, and the ``turns`` that they refer to by ``turn_at``."""

    nodes: DataFrame
    turns: DataFrame

    def with_turns(self) -> DataFrame:
        """Nodes with role and text of their last turn; the root has none."""
        stored = self.turns.select(F.col("at").alias("turn_at"), "role", "text")
        return self.nodes.join(stored, "turn_at", "left")


def trie(
    conversations: DataFrame, base: Column | None = None, head: Column | None = None, modulus: int = MODULUS
) -> Trie:
    """The trie of ``conversations(conv_id, turn, role, text)``.

    ``base`` and ``head`` are expressions over ``conv_id``: the conversation whose first ``head`` turns stand for its own
    first ones. Without them every conversation stands as it is.

    One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (of the root: null), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256`` and ``turn_at``.
    """
    base = F.col("conv_id") if base is None else base.cast("long")
    head = F.lit(0) if head is None else head.cast("int")
    turns = stored_turns(conversations)
    convs = written(_rebuilt(turns, base, head))
    for seed in itertools.count():
        members = written(_members(turns, convs, seed, modulus))
        nodes = written(_nodes(members))
        if _verified(turns, nodes, seed):
            return Trie(_with_sums(members, nodes, convs), turns)


def op13_digest(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def grafted(conversations: DataFrame) -> Trie:
    """The trie in which every conversation goes on from the first of its hundred, by the rules of the registered query."""
    conv = F.col("conv_id")
    return trie(conversations, conv - conv % GROUP, F.crc32(conv.cast("string")) % HEADS)


# --- turns and their products ---------------------------------------------------------------------


def stored_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``position`` (from 1), ``at`` (a number of its own), ``role`` and ``text`` of every turn, as a table."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    ranges = [F.col("turn"), F.substring("role", 1, ROLE_BEGINNING), F.substring("text", 1, TEXT_BEGINNING)]
    order = [F.col("turn"), F.col("role"), F.col("text")]
    numbered = with_rank(rows, [F.col("conv_id")], order, ranges=ranges, name="position", place="at")
    return written(numbered.select("conv_id", "position", "at", "role", "text"))


def _hashes(seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(2 * seed), "role", "text"), F.xxhash64(F.lit(2 * seed + 1), "text", "role")


def _map_of(one: Column, two: Column, modulus: int) -> Column:
    """Two affine maps as a struct of their factors and constants."""

    def half(hashed: Column, n: int) -> Column:
        return F.shiftrightunsigned(hashed, 33 * n).bitwiseAND(F.lit((1 << 31) - 1))

    fields = {}
    for i, hashed in enumerate((one, two)):
        fields[f"a{i}"] = half(hashed, 0) % (modulus - 1) + 1
        fields[f"b{i}"] = half(hashed, 1) % modulus
    return F.struct(*[column.alias(name) for name, column in fields.items()])


def _identity() -> Column:
    return F.struct(*[F.lit(int(name[0] == "a")).cast("long").alias(name) for name in ("a0", "b0", "a1", "b1")])


def _then(first: Column, second: Column, modulus: int) -> Column:
    """The map that does ``first`` and ``second`` one after the other."""
    fields = {}
    for i in (0, 1):
        a, b = second[f"a{i}"], second[f"b{i}"]
        fields[f"a{i}"] = first[f"a{i}"] * a % modulus
        fields[f"b{i}"] = (first[f"b{i}"] * a + b) % modulus
    return F.struct(*[column.alias(name) for name, column in fields.items()])


def _packed(product: Column) -> list[Column]:
    """A product as two numbers."""
    return [F.shiftleft(product[f"a{i}"], 31).bitwiseOR(product[f"b{i}"]) for i in (0, 1)]


def running_products(elements: DataFrame, largest: int, modulus: int) -> DataFrame:
    """Add ``product`` to ``(conv_id, at_step, map, ...)``: of all maps of the conversation up to this step (from 0).

    Steps are multiplied in blocks; the products of blocks are multiplied the same way, level by level until one
    block holds all, and each block goes on from the product of those before.
    """
    rest = [c for c in elements.columns if c not in ("conv_id", "at_step", "map")]
    item = F.struct("at_step", "map", *rest)
    block = F.floor(F.col("at_step") / BLOCK).cast("long").alias("block")
    blocks = elements.groupBy("conv_id", block).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def scan(start: Column) -> Column:
        return F.slice(
            F.aggregate(
                "items",
                F.array(start),
                lambda done, x: F.concat(done, F.array(_then(F.element_at(done, -1), x["map"], modulus))),
            ),
            2,
            F.size("items"),
        )

    if largest >= BLOCK:
        blocks = written(blocks)
        ends = blocks.select("conv_id", F.col("block").alias("at_step"), F.element_at(scan(_identity()), -1).alias("map"))
        before = running_products(ends, largest // BLOCK, modulus)
        before = before.select("conv_id", (F.col("at_step") + 1).alias("block"), F.col("product").alias("start"))
        blocks = blocks.join(before, ["conv_id", "block"], "left").withColumn("start", F.coalesce("start", _identity()))
    else:
        blocks = blocks.withColumn("start", _identity())
    pairs = blocks.select("conv_id", F.explode(F.arrays_zip("items", scan(F.col("start")).alias("products"))).alias("pair"))
    columns = [F.col(f"pair.items.{c}").alias(c) for c in ("at_step", "map", *rest)]
    return pairs.select("conv_id", *columns, F.col("pair.products").alias("product"))


# --- members and nodes ----------------------------------------------------------------------------


def _rebuilt(turns: DataFrame, base: Column, head: Column) -> DataFrame:
    """Each conversation with its base, the length of its head as it was asked for and as it is there, and its length."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    asked = sizes.select("conv_id", "own", base.alias("base"), F.greatest(head, F.lit(0)).cast("long").alias("asked"))
    there = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = asked.join(there, "base", "left").withColumn("head", F.least("asked", F.coalesce("of_base", F.lit(0))))
    length = F.col("head") + F.greatest(F.col("own") - F.col("asked"), F.lit(0))
    return convs.select("conv_id", "base", "asked", "head", "own", length.alias("length"))


def _members(turns: DataFrame, convs: DataFrame, seed: int, modulus: int) -> DataFrame:
    """One row per rebuilt conversation and depth: fingerprints of the prefix and of its parent, and its last turn."""
    one, two = _hashes(seed)
    hashed = turns.select("conv_id", "position", "at", F.length("text").alias("chars"), one.alias("one"), two.alias("two"))
    hashed = hashed.withColumn("map", _map_of(F.col("one"), F.col("two"), modulus))
    longest = convs.agg(F.max("asked").alias("asked"), F.max("own").alias("own")).first()
    turn = ["at", "chars", "one", "two"]

    # prefixes of the heads that are asked for, once per base however many go on from it
    heads = convs.where("head > 0").groupBy(F.col("base").alias("conv_id")).agg(F.max("head").alias("deepest"))
    of_heads = hashed.join(heads, "conv_id").where(F.col("position") <= F.col("deepest"))
    of_heads = of_heads.select("conv_id", (F.col("position") - 1).alias("at_step"), "map", *turn)
    prefixes = running_products(of_heads, int(longest.asked or 0), modulus)
    prefixes = written(prefixes.select(F.col("conv_id").alias("base"), (F.col("at_step") + 1).alias("depth"), "product", *turn))

    # the start of the trie, and what each conversation has of its base
    starts = convs.select("conv_id", "base", "head", "length")
    root = starts.select("conv_id", F.lit(0).cast("long").alias("depth"), _identity().alias("product"), _identity().alias("parent"), *_no_turn(), "length")
    above = prefixes.select("base", (F.col("depth") + 1).alias("depth"), F.col("product").alias("parent"))
    prefixes = prefixes.join(above, ["base", "depth"], "left").withColumn("parent", F.coalesce("parent", _identity()))
    taken = starts.where("head > 0").join(prefixes, "base").where(F.col("depth") <= F.col("head"))
    taken = taken.select("conv_id", "depth", "product", "parent", *turn, "length")

    # what follows the head, from the conversation's own turns
    left = hashed.join(convs.select("conv_id", "asked"), "conv_id").where(F.col("position") > F.col("asked"))
    left = left.select("conv_id", (F.col("position") - F.col("asked") - 1).alias("at_step"), "map", *turn)
    own = running_products(left, int(longest.own or 0), modulus)
    # the product up to the step before, found by its neighbour rather than by dividing
    before = own.select("conv_id", (F.col("at_step") + 1).alias("at_step"), F.col("product").alias("previous"))
    own = own.join(before, ["conv_id", "at_step"], "left")
    ends = prefixes.select("base", F.col("depth").alias("head"), F.col("product").alias("start"))
    joints = starts.where(F.col("length") > F.col("head")).join(ends, ["base", "head"], "left")
    own = own.join(joints.select("conv_id", "head", "length", F.coalesce("start", _identity()).alias("start")), "conv_id")
    product = _then(F.col("start"), F.col("product"), modulus)
    parent = _then(F.col("start"), F.coalesce("previous", _identity()), modulus)
    own = own.select(
        "conv_id", (F.col("head") + F.col("at_step") + 1).alias("depth"), product.alias("product"), parent.alias("parent"), *turn, "length"
    )

    rows = root.unionByName(taken).unionByName(own)
    names = [c.alias(n) for c, n in zip([*_packed(F.col("product")), *_packed(F.col("parent"))], [*NODE[1:], *PARENT], strict=True)]
    return rows.select("conv_id", "depth", *names, *turn, (F.col("depth") == F.col("length")).alias("ends"))


def _no_turn() -> list[Column]:
    """The root has no last turn."""
    return [
        F.lit(None).cast("long").alias("at"),
        F.lit(0).alias("chars"),
        F.lit(0).cast("long").alias("one"),
        F.lit(0).cast("long").alias("two"),
    ]


def _nodes(members: DataFrame) -> DataFrame:
    """Members of one depth and fingerprint, and whether they agree about parent and last turn."""
    shared = ["chars", "one", "two", *PARENT]
    agree = F.lit(True)
    for name in shared:
        agree = agree & (F.min(name) == F.max(name))
    return members.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.min("at").alias("turn_at"),
        *[F.min(name).alias(name) for name in shared],
        agree.alias("agree"),
    )


def _verified(turns: DataFrame, nodes: DataFrame, seed: int) -> bool:
    """Whether members of each node share parent and last turn, and turns of one hash role and text."""
    if nodes.where(~F.col("agree")).limit(1).count():
        return False
    one, two = _hashes(seed)
    unlike = (F.min("role") != F.max("role")) | (F.min("text") != F.max("text"))
    same_hash = turns.groupBy(one.alias("one"), two.alias("two")).agg(unlike.alias("unlike"))
    return not same_hash.where("unlike").limit(1).count()


# --- sums over subtrees ---------------------------------------------------------------------------


def _with_sums(members: DataFrame, nodes: DataFrame, convs: DataFrame) -> DataFrame:
    above = [(F.col("depth") - 1).alias("depth"), F.col("parent_f").alias("f"), F.col("parent_g").alias("g")]
    children = nodes.where("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = nodes.withColumn("saved", ((F.col("n_convs") - 1) * F.col("chars")).cast("long"))

    # the nodes that a conversation is the least member of are the lower end of its path
    piece = F.floor(F.col("depth") / DEPTHS).cast("long")
    nodes = written(nodes.withColumn("piece", piece))
    pieces = nodes.groupBy("conv_id", "piece").agg(F.sum("saved").alias("sum"), F.max(F.col("n_children") == 0).alias("leaf"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("conv_id", "piece", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("above", F.coalesce(F.sum("saved").over(within), F.lit(0)))
    nodes = nodes.join(offsets.where("offset > 0"), ["conv_id", "piece"], "left")
    nodes = nodes.withColumn("above", F.col("above") + F.coalesce("offset", F.lit(0))).drop("offset", "piece")

    brought = pieces.groupBy("conv_id").agg(F.sum("sum").alias("sum"), F.max("leaf").cast("long").alias("leaf"))
    brought = brought.where((F.col("sum") > 0) | (F.col("leaf") > 0))
    sums = members.select("conv_id", *NODE).join(brought, "conv_id").groupBy(*NODE)
    sums = sums.agg(F.sum("sum").alias("sum"), F.sum("leaf").alias("n_leaves"))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f").alias("parent_f"), F.col("g").alias("parent_g"), F.col("conv_id").alias("parent_conv_id"))
    # the root would meet itself, and its children are as many as there are first turns: its member is known without a join
    below = nodes.join(parents.where("depth > 1"), ["depth", *PARENT], "left")
    least = convs.agg(F.min("conv_id")).scalar()
    below = below.withColumn("parent_conv_id", F.when(F.col("depth") == 1, least).otherwise(F.col("parent_conv_id")))
    whole = below.join(sums, NODE, "left").join(_ends(members), NODE, "left")
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
        (F.coalesce("sum", F.lit(0)) - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        "turn_at",
    )


def _ends(members: DataFrame) -> DataFrame:
    """The digest of the ids that end at each node.

    Neighbouring ids are joined to a text first, by partial aggregates; the texts of a node then stream
    through one digest in their order, which a digest of all of them cannot do without.
    """
    piece = F.shiftright("conv_id", ID_BITS).alias("piece")
    ids = members.where("ends").groupBy(*NODE, piece).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    pieces = ids.select(*NODE, "piece", text.alias("ids")).repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return pieces.mapInArrow(_digests, "depth long, f long, g long, ends_sha256 string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*NODE, "ends_sha256"]
    node, digest = None, None
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in (*NODE, "ids")]
        done = []
        for *key, ids in zip(*columns, strict=True):
            if key != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if done:
            yield _batch(done, names)
    if node is not None:
        yield _batch([(*node, digest.hexdigest())], names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
