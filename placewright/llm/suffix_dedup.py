"""Suffix-array dedup: remove what a string of ``LENGTH`` bytes repeats from a document with a smaller id.

Sorting all suffixes would shuffle many times the input, so suffixes are sorted where repeats can be:

1. Every window of ``LENGTH`` bytes has an anchor, its ``GRAM`` bytes of least hash (the leftmost of equal
   ones). Equal windows have equal anchors, so a window repeats only if another document has its anchor.
   Anchors are counted over all documents; most occur once and are done.
2. An occurrence of a shared anchor goes, with the bytes of the windows that it stands for, to the other
   occurrences. There the suffixes that begin at the anchors are sorted by deep-shallow sorting, and so are the
   reversed bytes before them. Windows with the anchor at the same offset are equal if both common prefixes reach their
   ends; the least document of equal windows keeps them, for the others they are marked.
3. Anchors with more than ``HOT`` occurrences are not brought together: their windows are hashed (128 bits), and the least
   document of a window is an aggregate, combined before the shuffle.
4. Marked windows are merged per document and cut out.

Equal texts are found first by hash; all but the least document are removed as a whole and take no further part.
Tasks hold a bounded number of occurrences (``CHUNK`` and one anchor's, at most ``HOT``).

Defined cases: a null text is empty; documents below ``LENGTH`` bytes stay; a null ``doc_id`` counts as the least
one; rows with the same ``doc_id`` are documents of their own that remove nothing from each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.suffix_sort import deep_shallow
from placewright.scratch import written

LENGTH, GRAM = 50, 20
#: Offsets at which a window can hold its anchor.
OFFSETS = LENGTH - GRAM + 1
#: Occurrences of one anchor that a task sorts together: some 70 bytes each, and 300 more while they are sorted.
HOT = 100_000
#: Occurrences that are sorted together, and bytes of text worked through at once.
CHUNK, BUFFER = 20_000, 1 << 17
#: Tables of hashes are broadcast up to this number of rows (some 24 bytes each), and shuffled beyond it.
BROADCAST_ROWS = 4_000_000
LEAST_ID = -(1 << 63)
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0x9FB21C651E98DF25)]


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes that begin at each place, built from hashes of doubled lengths."""
    powers = {1: data.astype(np.uint64) + np.uint64(1)}
    length = 1
    while 2 * length <= size:
        half = powers[length]
        n = len(half) - length
        powers[2 * length] = half[:n] * MIX[1] + (half[length:] ^ (half[length:] >> np.uint64(29))) * MIX[0]
        length *= 2
    n = len(data) - size + 1
    total, done = np.zeros(n, np.uint64), 0
    for length in sorted(powers, reverse=True):
        if size - done >= length:
            total = (total ^ (total >> np.uint64(31))) * MIX[2] + powers[length][done : done + n]
            done += length
    total = (total ^ (total >> np.uint64(32))) * MIX[0]
    return total ^ (total >> np.uint64(29))


def least_places(hashes: np.ndarray, window: int = OFFSETS) -> np.ndarray:
    """Where the least (leftmost) of ``window`` hashes from each place on is."""
    places, values, length = np.arange(len(hashes), dtype=np.int32), hashes, 1
    while length < window:
        step = min(length, window - length)
        places = np.where(values[:-step] <= values[step:], places[:-step], places[step:])
        values = np.minimum(values[:-step], values[step:])
        length += step
    return places


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts one after another: hash and place of every anchor, and its first and last window."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    if len(data) < LENGTH:
        return none
    hashes = gram_hashes(data)
    places = least_places(hashes)[: len(data) - LENGTH + 1]
    own_end = np.repeat(ends, np.diff(np.append(0, ends)))[: len(places)]
    windows = np.flatnonzero(np.arange(len(places)) + LENGTH <= own_end)
    if not len(windows):
        return none
    chosen = places[windows]
    begins = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1)))
    lasts = np.append(begins[1:], len(windows)) - 1
    return hashes[chosen[begins]], chosen[begins], windows[begins], windows[lasts]


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[bytes]]]:
    """Ids, parts and bytes of some ``BUFFER`` bytes of documents."""
    ids, parts, texts, size = [], [], [], 0
    for batch in batches:
        for doc_id, part, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "text")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            ids.append(doc_id)
            parts.append(part)
            texts.append(raw)
            size += len(raw)
            if size >= BUFFER:
                yield ids, parts, texts
                ids, parts, texts, size = [], [], [], 0
    if ids:
        yield ids, parts, texts


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of anchors, once for each document with the number of times."""
    for _, _, texts in _buffers(batches):
        data, ends = _joined(texts)
        hashes, places, _, _ = anchors(data, ends)
        owner = np.searchsorted(ends, places, "right")
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        if not len(hashes):
            continue
        once = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
        times = np.diff(np.append(once, len(hashes)))
        yield pa.RecordBatch.from_arrays([pa.array(hashes[once].view(np.int64)), pa.array(times.astype(np.int64))], names=["anchor", "times"])


OCCURRENCE = "anchor long, doc_id long, part long, start long, offset int, bytes binary"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every anchor with the bytes of its windows, the start of the first one, and its offset in the bytes."""
    for ids, parts, texts in _buffers(batches):
        data, ends = _joined(texts)
        hashes, places, first, last = anchors(data, ends)
        owner = np.searchsorted(ends, places, "right")
        begins = np.append(0, ends[:-1])
        sizes = last - first + LENGTH
        offsets = np.append(0, np.cumsum(sizes))
        flat = data[np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], sizes)]
        for a in range(0, len(hashes), 1 << 18):
            b = min(a + (1 << 18), len(hashes))
            part = flat[offsets[a] : offsets[b]]
            binary = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((offsets[a : b + 1] - offsets[a]).astype(np.int32)), pa.py_buffer(part)])
            columns = [
                pa.array(hashes[a:b].view(np.int64)),
                pa.array(np.array(ids, np.int64)[owner[a:b]]),
                pa.array(np.array(parts, np.int64)[owner[a:b]]),
                pa.array(first[a:b] - begins[owner[a:b]]),
                pa.array((places[a:b] - first[a:b]).astype(np.int32)),
                binary,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "doc_id", "part", "start", "offset", "bytes"])


def repeated_windows(anchor: np.ndarray, doc: np.ndarray, offset: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """For each occurrence and offset (of the anchor in a window): whether a smaller document has that window."""
    n = len(raw)
    sizes = np.array([len(r) for r in raw])
    windows = sizes - LENGTH + 1
    # smallest documents first, so that the first of equal windows is the one that keeps it
    after = np.frombuffer(b"".join(r[o : o + LENGTH].ljust(56, b"\0") for r, o in zip(raw, offset.tolist(), strict=True)), np.uint8).reshape(n, 56)
    before = np.frombuffer(b"".join(r[:o][::-1].ljust(32, b"\0") for r, o in zip(raw, offset.tolist(), strict=True)), np.uint8).reshape(n, 32)
    after_order, after_common = deep_shallow(anchor, after, 4)
    before_order, before_common = deep_shallow(anchor, before, 2)
    marked = np.zeros((n, OFFSETS), bool)
    by_doc = np.argsort(doc, kind="stable")
    after_class, before_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for at in range(OFFSETS):
        members = by_doc[(offset[by_doc] >= at) & (offset[by_doc] - windows[by_doc] < at)]
        if len(members) < 2:
            continue
        after_class[after_order] = np.cumsum(after_common < LENGTH - at)
        before_class[before_order] = np.cumsum(before_common < at)
        key = after_class[members] * (n + 1) + before_class[members]
        order = np.argsort(key, kind="stable")
        key, members = key[order], members[order]
        new = np.append(True, key[1:] != key[:-1])
        least = doc[members[new]][np.cumsum(new) - 1]
        marked[members, at] = doc[members] > least
    return marked


def _ranges(marked: np.ndarray, offset: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last start of each run of marked windows; a larger offset is an earlier window."""
    earlier = np.hstack([np.zeros((len(marked), 1), bool), marked[:, ::-1], np.zeros((len(marked), 1), bool)])
    change = np.diff(earlier.astype(np.int8), axis=1)
    rows, begin = np.nonzero(change == 1)
    _, end = np.nonzero(change == -1)
    # column c stands for the offset OFFSETS - 1 - c
    base = start[rows] + offset[rows] - (OFFSETS - 1)
    return rows, base + begin, base + end - 1


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows from occurrences that arrive in the order of their anchors."""

    def marked(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        anchor, doc, part, start = (table[c].to_numpy() for c in ("anchor", "doc_id", "part", "start"))
        offset = table["offset"].to_numpy().astype(np.int64)
        rows, first, last = _ranges(repeated_windows(anchor, doc, offset, table["bytes"].to_pylist()), offset, start)
        columns = [pa.array(doc[rows]), pa.array(part[rows]), pa.array(first), pa.array(last)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "first", "last"])

    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        for a in range(0, batch.num_rows, CHUNK):
            piece = batch.slice(a, CHUNK)
            waiting.append(piece)
            held += piece.num_rows
            if held < CHUNK:
                continue
            # the last anchor may go on in the next piece
            table = pa.Table.from_batches(waiting).combine_chunks()
            anchor = table["anchor"].to_numpy()
            cut = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if (anchor != anchor[-1]).any() else 0
            if cut:
                yield marked(table.slice(0, cut).to_batches())
            waiting = table.slice(cut).to_batches()
            held -= cut
    if held:
        yield marked(waiting)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of occurrences by hash."""
    for batch in batches:
        out: list[list[int]] = [[], [], [], [], []]
        for doc_id, part, start, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "start", "bytes")), strict=True):
            for i in range(len(raw) - LENGTH + 1):
                digest = xxhash.xxh128_intdigest(raw[i : i + LENGTH])
                for values, value in zip(out, (doc_id, part, start + i, (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)), strict=True):
                    values.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "part", "first", "w1", "w2"])


def _small(table: DataFrame) -> DataFrame:
    table = written(table)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part`` and the first and last start of runs of windows that a smaller document has."""
    rows = _rows(docs)
    seen = rows.select("doc_id", "part", F.xxhash64(F.lit(7), "text").alias("other_hash"), F.octet_length("text").alias("n"))
    seen = written(seen.where(F.col("n") >= LENGTH))
    least = seen.groupBy("part", "other_hash").agg(F.min("doc_id").alias("least"))
    copies = seen.join(least, ["part", "other_hash"]).where("doc_id > least").select("doc_id", "part", "n").distinct()
    copies = _small(copies)
    fresh = rows.join(copies, ["doc_id", "part"], "left_anti").where(F.octet_length("text") >= LENGTH)

    counted = fresh.select("doc_id", "part", "text").mapInArrow(_count_anchors, "anchor long, times long")
    counted = counted.groupBy("anchor").agg(F.count("*").alias("n_docs"), F.sum("times").alias("n_times"))
    shared = _small(counted.where("n_docs > 1").select("anchor", "n_times"))
    found = fresh.select("doc_id", "part", "text").mapInArrow(_occurrences, OCCURRENCE).join(shared, "anchor")
    names = [c.split()[0] for c in OCCURRENCE.split(", ")]
    few = found.where(F.col("n_times") <= HOT).select(names).repartition("anchor").sortWithinPartitions("anchor")
    marked = few.mapInArrow(_mark, "doc_id long, part long, first long, last long")

    whole = copies.select("doc_id", "part", F.lit(0).cast("long").alias("first"), (F.col("n") - LENGTH).cast("long").alias("last"))
    marked = marked.union(whole)
    if shared.where(F.col("n_times") > HOT).isEmpty():
        return marked
    hot = found.where(F.col("n_times") > HOT).select(names).mapInArrow(_windows, "doc_id long, part long, first long, w1 long, w2 long")
    hot = written(hot)
    least = hot.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"))
    again = hot.join(least, ["w1", "w2"]).where("doc_id > least").select("doc_id", "part", "first", F.col("first").alias("last"))
    return marked.union(again)


def _rows(docs: DataFrame) -> DataFrame:
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))
    text = F.coalesce("text", F.lit(""))
    return docs.select(ids.alias("doc_id"), F.xxhash64(text).alias("part"), text.alias("text"))


def spans(firsts: np.ndarray, lasts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows starting in the given ranges cover."""
    found: list[tuple[int, int]] = []
    order = np.argsort(firsts, kind="stable")
    for begin, end in zip(firsts[order].tolist(), (lasts[order] + LENGTH).tolist(), strict=True):
        if found and begin <= found[-1][1]:
            found[-1] = found[-1][0], max(end, found[-1][1])
        else:
            found.append((begin, end))
    return found


def cut(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` bytes of every document."""
    runs = repeats(docs).groupBy(F.col("doc_id").alias("d"), F.col("part").alias("p")).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    rows = _rows(docs)
    rows = rows.join(runs, (F.col("doc_id") == F.col("d")) & (F.col("part") == F.col("p")), "left").select("doc_id", "text", "runs")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            column = batch.column("runs")
            for row, text in enumerate(batch.column("text").to_pylist()):
                raw, runs = text.encode("utf-8", "surrogatepass"), column[row].values
                gone = []
                if runs is not None:
                    gone = spans(runs.field("first").to_numpy(), runs.field("last").to_numpy())
                rest, at = [], 0
                for begin, end in gone:
                    rest.append(raw[at:begin])
                    at = end
                rest = b"".join([*rest, raw[at:]])
                out.append((len(raw), len(raw) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest))
            ids = pa.array([None if i == LEAST_ID else i for i in ids], pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [ids, *(pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
