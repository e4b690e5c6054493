"""Document fingerprints: SimHash, and permuted block tables that find near ones.

Terms are pairs of neighbouring words (a text of one word has that word), weighted by one plus the
logarithm of their count. Each term's 128-bit hash votes with its weight for or against every bit; a
bit is set if the votes for it prevail. Likeness of two fingerprints is the share of equal bits.

``chain_fingerprints`` also takes an edited form of every text, whose end comes from the next
document. For that the texts move once, range-partitioned by ``doc_id``, and each task walks its
sorted rows in Arrow batches; only the first and last text of every task (their number is that of the
tasks) meet in a second step.

``near_counts`` finds all fingerprints within ``RADIUS`` bits: of ``RADIUS + 1`` blocks at least one
is equal in such a pair, so one table per block, keyed by that block, holds every pair. Equal
fingerprints are one row with a count before they meet.

Defined cases: a null text is empty; texts without words have the fingerprint of zero bits; a null
``doc_id`` comes first; rows of equal ``doc_id`` follow each other by the hash of their text; a
single document is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.tables import WORD, texts
from placewright.scratch import written

BITS, RADIUS = 128, 3
#: Words whose hashes a task remembers at once; the table starts anew when it is full.
REMEMBERED_WORDS = 1 << 20
MULTIPLIER, OTHER_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * multiplier
    return (x ^ (x >> np.uint64(29))) * MULTIPLIER


class Fingerprinter:
    """SimHash of one text after another."""

    def __init__(self) -> None:
        self.words, self.find = _WordHashes(), re.compile(WORD).findall

    def __call__(self, text: str) -> bytes:
        remembered = self.words
        words = np.array([remembered[w] for w in self.find(text)], np.uint64)
        if not len(words):
            return bytes(BITS // 8)
        pairs = words[:-1] * OTHER_MULTIPLIER + (words[1:] ^ (words[1:] >> np.uint64(31))) if len(words) > 1 else words
        terms, counts = np.unique(pairs, return_counts=True)
        weights = (1 + np.log(counts)).astype(np.float32)
        votes = np.zeros(BITS, np.float32)
        for start in range(0, len(terms), 1 << 16):
            part = terms[start : start + (1 << 16)]
            hashes = np.stack([_mixed(part, MULTIPLIER), _mixed(part, OTHER_MULTIPLIER)], axis=1)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(len(part), BITS // 8), axis=1)
            votes += weights[start : start + (1 << 16)] @ bits
        return np.packbits(votes > weights.sum() / 2).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _result(doc_id, text: str, own: bytes, after: str, after_own: bytes, fingerprint: Fingerprinter) -> tuple:
    n, moved = len(text), len(text) // 2
    edited = text[: n - moved] + after[:moved]
    changed = fingerprint(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, n, digest, own.hex(), changed.hex(), likeness(own, changed), likeness(own, after_own)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
        for doc_id, text in zip(ids, batch["text"], strict=True):
            yield None if doc_id is None else int(doc_id), text


NAMES = [column.split()[0] for column in RESULT.split(", ")]
#: Rows that a task hands over at once.
BATCH = 4096


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({c: "Int64" for c in ("doc_id", "n_chars", "task") if c in names})


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results of a sorted partition; its first and last rows also, or only, with their texts."""
    task, fingerprint, out = TaskContext.get().partitionId(), Fingerprinter(), []
    blank, names = (None,) * (len(NAMES) - 1), [*NAMES, "task", "open", "text"]
    last = None
    for doc_id, text in _rows(batches):
        own = fingerprint(text)
        if last is None:
            out.append((doc_id, *blank, task, "first", text))
        else:
            out.append((*_result(*last, text, own, fingerprint), task, None, None))
        last = doc_id, text, own
        if len(out) >= BATCH:
            yield _frame(out, names)
            out = []
    if last is not None:
        out.append((last[0], *blank, task, "last", last[1]))
    if out:
        yield _frame(out, names)


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    fingerprint = Fingerprinter()
    for batch in batches:
        ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
        rows = zip(ids, batch["text"], batch["after"], strict=True)
        yield _frame([_result(None if i is None else int(i), a, fingerprint(a), b, fingerprint(b), fingerprint) for i, a, b in rows], NAMES)


def chain_fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of ``RESULT`` for every row of ``docs``."""
    rows = texts(docs).withColumn("hash", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    walked = written(rows.mapInPandas(_walk, f"{RESULT}, task long, open string, text string"))
    firsts = walked.where("open = 'first'").select("task", F.col("text").alias("after"))
    lasts = walked.where("open = 'last'").select("task", "doc_id", "text")
    order = Window.partitionBy(F.lit(0)).orderBy("task")
    following = firsts.select("task", F.lead("task").over(order).alias("next"), F.min("task").over(Window.partitionBy(F.lit(0))).alias("least"))
    following = following.select("task", F.coalesce("next", "least").alias("next"))
    ends = lasts.join(following, "task").join(firsts.withColumnRenamed("task", "next"), "next").select("doc_id", "text", "after")
    return walked.where("open is null").select(*NAMES).union(ends.mapInPandas(_meet, RESULT))


def _halves(fingerprint):
    """A hexadecimal fingerprint as ``RADIUS + 1`` blocks."""
    size = BITS // 4 // (RADIUS + 1)
    return [F.substring(fingerprint, 1 + i * size, size) for i in range(RADIUS + 1)]


def near_counts(fingerprints: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``n_near``: the other documents within ``RADIUS`` bits, for the query set.

    Queries are the rows whose ``doc_id`` is divisible by 20; they are looked up among all rows.
    """
    counts = fingerprints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 20 == 0).alias("asked"))
    blocks = _halves(F.col("fingerprint"))
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), b.alias("block")) for i, b in enumerate(blocks)]))
    keyed = counts.select("fingerprint", "n", "asked", tables.alias("key")).select("fingerprint", "n", "asked", "key.table", "key.block")
    asked = keyed.where("asked > 0").select(F.col("fingerprint").alias("query"), "table", "block")

    def differing(start: int):
        a, b = (F.conv(F.substring(c, start, 8), 16, 10).cast("long") for c in ("query", "fingerprint"))
        return F.bit_count(a.bitwiseXOR(b))

    distance = sum((differing(start) for start in range(1, BITS // 4, 8)), F.lit(0))
    # a pair counts in the first table that holds it
    earlier = F.lit(True)
    for i, (a, b) in enumerate(zip(_halves(F.col("query")), _halves(F.col("fingerprint")), strict=True)):
        earlier = earlier & ((F.col("table") <= i) | (a != b))
    pairs = asked.join(keyed, ["table", "block"]).where(earlier & (distance <= RADIUS))
    found = pairs.groupBy("query").agg((F.sum("n") - 1).alias("n_near"))
    queries = fingerprints.where(F.col("doc_id") % 20 == 0).select("doc_id", F.col("fingerprint").alias("query"))
    return queries.join(found, "query").select("doc_id", F.col("query").alias("fingerprint"), "n_near")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``RESULT`` and ``n_near`` (null outside the query set)."""
    chained = written(chain_fingerprints(docs))
    near = near_counts(chained.select("doc_id", "fingerprint")).distinct()
    # rows of one doc_id can differ in their texts, and so in what is near them
    return chained.join(near, ["doc_id", "fingerprint"], "left").select(*NAMES, "n_near")
