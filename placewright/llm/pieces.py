"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text gets a leading space, spaces become the marker ``▁``, and of all ways to cut it into pieces
the one with the highest sum of the pieces' log scores is taken; of equal ones the one whose last
pieces are longest. A character that no piece of one character covers costs ``UNKNOWN`` more than the
worst piece and is spelled as its UTF-8 bytes. Decoding joins the pieces and turns markers to spaces.

No piece continues from another character into a marker, and a character in no piece is always
spelled as bytes, so the best cut of a text is the best cuts of its units (a word with the markers
before it, or such a character). Each Arrow batch encodes every different unit once: units
of like length step through the trie together as NumPy arrays, and results are gathered per document.
Sums stay within a unit, so that no precision is lost in long texts.

The model file is read on the driver only (it is a vocabulary of bounded size); tasks get its trie.

Defined cases: a null text is encoded like an empty one, to no pieces; the marker in a text is decoded
as a space, the only loss; repeated rows are encoded alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.llm.tables import shipped

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: Fixed value: what an unknown character costs below the lowest score.
UNKNOWN = 10.0
#: Units up to this many bytes are encoded side by side, in groups of like length; longer ones one by one.
SIDE_BY_SIDE = 64


class DoubleArray:
    """A trie as two arrays: the child of state ``s`` by byte ``b`` is ``base[s] + b`` if ``check`` there is ``s``."""

    def __init__(self, keys: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for number, key in enumerate(keys):
            node = 0
            for byte in key:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][byte]
            ends[node] = number
        # bases first, nodes with many children before those with few, which then fill the gaps
        taken = bytearray(len(children) + 512)
        taken[0] = 1
        bases, first_gap, cursor = [0] * len(children), 256, 256  # from 256 on, any byte can be placed
        for node in sorted(range(len(children)), key=lambda i: -len(children[i])):
            below = sorted(children[node])
            if not below:
                break
            if len(below) == 1:
                first_gap = taken.index(0, first_gap)
                base = first_gap - below[0]
            else:
                base, tries = cursor - below[0], 0
                while any(taken[base + b] for b in below):
                    base, tries = base + 1, tries + 1
                    if base + 257 > len(taken):
                        taken.extend(bytes(len(taken)))
                if tries > 16:
                    cursor = base + below[0]
            bases[node] = base
            for b in below:
                taken[base + b] = 1
            if base + 513 > len(taken):
                taken.extend(bytes(len(taken)))
        self.base, self.check, self.value = (np.full(len(taken), fill, np.int32) for fill in (0, -1, -1))
        place = {0: 0}
        for node, below in enumerate(children):  # parents come before their children
            state = place.pop(node)
            self.base[state], self.value[state] = bases[node], ends[node]
            for byte, child in below.items():
                place[child] = bases[node] + byte
                self.check[place[child]] = state

    def step(self, states: np.ndarray, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and which of them exist."""
        following = self.base[states] + bytes_
        return following, self.check[following] == states


class Pieces:
    """A vocabulary ready to encode and decode."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        given = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(given.get_piece_size())
        special = {i for i in every if given.is_byte(i) or given.is_control(i) or given.is_unknown(i) or given.is_unused(i)}
        names = [given.id_to_piece(i) for i in every]
        self.ids = np.array([i for i in every if i not in special], np.int32)
        self.scores = np.array([given.get_score(int(i)) for i in self.ids], np.float64)
        self.trie = DoubleArray([names[i].encode() for i in self.ids])
        self.unknown = float(self.scores.min()) - UNKNOWN
        self.byte_ids = np.array([given.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        spelled = {f"<0x{b:02X}>": bytes([b]) for b in range(256)}
        self.spellings = [b"" if i in special and not given.is_byte(i) else spelled.get(names[i], names[i].encode()) for i in every]
        plain = [names[i] for i in self.ids]
        across = any(re.search(f"[^{MARKER}]{MARKER}", p) for p in plain)
        used = set("".join(plain))
        alone = "".join(c for c in "\n\t\r" if c not in used)
        single = f"[{alone}]|" if alone else ""
        self.pattern = r"(?s).+" if across else f"{single}{MARKER}*[^{MARKER}{alone}]+|{MARKER}+"

    def units(self, text: str) -> list[str]:
        """The parts of a normalised text that are encoded by themselves."""
        if not text:
            return []
        return re.findall(self.pattern, MARKER + text.replace(" ", MARKER))

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after another, and where each unit begins and the last one ends."""
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        sizes = np.array([len(r) for r in raw], np.int64)
        order = np.argsort(sizes, kind="stable")
        parts, counts = [], np.zeros(len(raw), np.int64)
        start = 0
        while start < len(order):
            size = sizes[order[start]]
            room = 1 if size > SIDE_BY_SIDE else 1 << 16
            longest = size if size > SIDE_BY_SIDE else min(SIDE_BY_SIDE, (size + 3) // 4 * 4)
            end = min(start + room, int(np.searchsorted(sizes[order], longest, "right")))
            group = order[start:end]
            found, n = self._one(raw[group[0]]) if len(group) == 1 else self._side_by_side([raw[i] for i in group], sizes[group])
            parts.append(found)
            counts[group] = n
            start = end
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        # from the order of lengths back to the order of units
        begins = np.zeros(len(raw), np.int64)
        begins[order] = np.cumsum(counts[order]) - counts[order]
        offsets = np.append(0, np.cumsum(counts))
        return flat[gathered(begins, counts, offsets)], offsets

    def _side_by_side(self, raw: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width, trie = len(raw), int(sizes.max()), self.trie
        text = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(n, width).astype(np.int32)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int32)
        lengths = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        for start in range(width):
            rows = np.flatnonzero((best[:, start] > -np.inf) & (sizes > start))
            if not len(rows):
                continue
            alone, state = rows, np.zeros(len(rows), np.int32)
            covered = np.zeros(len(rows), bool)
            which = np.arange(len(rows))
            for end in range(start + 1, width + 1):
                state, fits = trie.step(state, text[rows, end - 1])
                fits &= sizes[rows] >= end
                rows, state, which = rows[fits], state[fits], which[fits]
                if not len(rows):
                    break
                number = trie.value[state]
                ends = np.flatnonzero(number >= 0)
                at, number = rows[ends], number[ends]
                covered[which[ends[lengths[at, start] == end - start]]] = True
                score = best[at, start] + self.scores[number]
                better = score > best[at, end]
                at = at[better]
                best[at, end], back[at, end], piece[at, end] = score[better], start, self.ids[number[better]]
            lost = alone[~covered]
            if len(lost):
                end = np.minimum(start + lengths[lost, start], sizes[lost])
                better = best[lost, start] + self.unknown > best[lost, end]
                lost, end = lost[better], end[better]
                best[lost, end] = best[lost, start] + self.unknown
                for offset in range(4):  # its bytes, one piece each
                    at = lost[start + offset < end]
                    if not len(at):
                        break
                    back[at, start + offset + 1] = start + offset
                    piece[at, start + offset + 1] = self.byte_ids[text[at, start + offset]]
        reverse = np.zeros((n, width), np.int32)
        counts, place, live = np.zeros(n, np.int64), sizes.copy(), np.arange(n)
        while len(live := live[place[live] > 0]):
            reverse[live, counts[live]] = piece[live, place[live]]
            place[live] = back[live, place[live]]
            counts[live] += 1
        last = np.arange(width)[None, :]
        forward = np.take_along_axis(reverse, np.clip(counts[:, None] - 1 - last, 0, width - 1), 1)
        return forward[last < counts[:, None]], counts

    def _one(self, raw: bytes) -> tuple[np.ndarray, int]:
        """A single unit of any length, byte by byte."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n, minus = len(raw), float("-inf")
        best, back, piece = [minus] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            if best[start] == minus:
                continue
            head = raw[start]
            length = 1 if head < 0x80 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4
            covered, state = False, 0
            for end in range(start + 1, n + 1):
                following = base[state] + raw[end - 1]
                if check[following] != state:
                    break
                state = following
                number = value[state]
                if number >= 0:
                    covered |= end - start == length
                    score = best[start] + self.scores[number]
                    if score > best[end]:
                        best[end], back[end], piece[end] = score, start, int(self.ids[number])
            end = min(n, start + length)
            if not covered and best[start] + self.unknown > best[end]:
                best[end] = best[start] + self.unknown
                for at in range(start, end):
                    back[at + 1], piece[at + 1] = at, int(self.byte_ids[raw[at]])
        found, at = [], n
        while at:
            found.append(piece[at])
            at = back[at]
        return np.array(found[::-1], np.int32), len(found)

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each begins and the last one ends."""
        numbers: dict[str, int] = {}
        seen, per_text = [], []
        for text in texts:
            units = self.units(text)
            seen.append(np.fromiter((numbers.setdefault(u, len(numbers)) for u in units), np.int64, len(units)))
            per_text.append(len(units))
        flat, offsets = self.encode_units(list(numbers))
        units = np.concatenate(seen) if seen else np.zeros(0, np.int64)
        counts = (offsets[1:] - offsets[:-1])[units]
        ends = np.append(0, np.cumsum(counts))
        return flat[gathered(offsets[units], counts, ends)], ends[np.append(0, np.cumsum(per_text)).astype(np.int64)]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.spellings.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").replace(MARKER, " ")[1:]


def gathered(begins: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions of several runs (begin, count) one after another; ``offsets`` are the runs' new places."""
    return np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], counts)


#: Characters of text that are encoded at once: a batch is worked through in steps of this size.
STEP = 1 << 21


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id``, ``ids`` (of the pieces), ``n_pieces``, and ``intact``: whether decoding gives the text back."""
    spark = docs.sparkSession
    shared = shipped(spark, Pieces(read_model(spark, model)))

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared()
        for batch in given:
            texts = batch.column("text").to_pylist()
            sizes = np.cumsum([len(t) for t in texts])
            steps = np.unique(np.searchsorted(sizes, np.arange(0, sizes[-1] + STEP, STEP), "right")) if len(sizes) else []
            for a, b in zip([0, *steps], [*steps, len(texts)], strict=True):
                if a < b:
                    yield encoded(pieces, batch.column("doc_id").slice(a, b - a), texts[a:b])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(batches, "doc_id long, ids array<int>, n_pieces long, intact boolean")


def encoded(pieces: Pieces, doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    flat, offsets = pieces.encode_texts(texts)
    intact = [pieces.decode(flat[a:b]) == t for a, b, t in zip(offsets[:-1], offsets[1:], texts, strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
    columns = [doc_ids, lists, pa.array(offsets[1:] - offsets[:-1], pa.int64()), pa.array(intact, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_pieces", "intact"])


def read_model(spark: SparkSession, path: str) -> bytes:
    """A model file: from the driver's disk, or by Spark if it has a scheme."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as file:
        return file.read()
