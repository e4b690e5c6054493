"""64-bit hashes of all words of many texts at once, by NumPy over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed together; a longer text is hashed by itself.
BUFFER = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads all their bits."""
    x = (x ^ (x >> np.uint64(31)) ^ np.uint64(salt)) * np.uint64(BASE)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes separate words, and a random number for each byte, the same for A-Z and a-z."""
    every = np.arange(256)
    space = (every == 0x20) | ((every >= 0x09) & (every <= 0x0D))
    lower = np.where((every >= 0x41) & (every <= 0x5A), every + 0x20, every)
    return space, mixed((lower + 1).astype(np.uint64) * np.uint64(0x165667B19E3779F9))


class WordHashes:
    """Hashes of the words (runs of bytes other than ASCII white space, A-Z lower-cased) of texts."""

    def __init__(self) -> None:
        self.space, self.numbers = _tables()
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                for name, base in (("powers", BASE), ("inverses", INVERSE)):
                    factors = np.full(n, base, np.uint64)
                    factors[0] = 1
                    setattr(self, name, np.cumprod(factors, dtype=np.uint64))

    def _hashed(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # a separator before and after each text, so that every word begins and ends between two places
        data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
        self._powers(len(data))
        space = self.space[data]
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        begins, ends = change[0::2], change[1::2]
        sums = np.cumsum(self.numbers[data] * self.powers[: len(data)])
        hashes = (sums[ends - 1] - sums[begins - 1]) * self.inverses[begins]
        hashes = mixed(hashes ^ (ends - begins).astype(np.uint64))
        text_ends = np.cumsum([len(r) + 1 for r in raw])
        return hashes, np.diff(np.append(0, np.searchsorted(begins, text_ends, "right")))

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The hashes of the words of each text, in order."""
        held: list[bytes] = []
        size = 0
        for i, text in enumerate(texts):
            held.append(text.encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size >= BUFFER or i == len(texts) - 1:
                hashes, counts = self._hashed(held)
                yield from np.split(hashes, np.cumsum(counts)[:-1])
                held, size = [], 0
