import hashlib
import random

import numpy as np
import pytest

from placewright.llm import suffix_dedup
from placewright.llm.suffix_dedup import cut
from placewright.llm.suffix_sort import blind_trie_order, deep_shallow
from tests.llm.helpers import documents, odd_rows


def brute(rows):
    low = [(-(2**63) if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in low:
        for s in {t[j : j + 50] for j in range(len(t) - 49)}:
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in low:
        gone = bytearray(len(t))
        for j in range(len(t) - 49):
            if first[t[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(b for b, x in zip(t, gone) if not x)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


def found(docs):
    rows = cut(docs).collect()
    return sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in rows)


def test_sorting():
    rng = random.Random(5)
    for _ in range(200):
        strings = list({bytes(rng.choice(b"ab") for _ in range(10)) for _ in range(rng.randint(2, 40))})
        assert [strings[i] for i in blind_trie_order(strings)] == sorted(strings)
    for _ in range(200):
        n = rng.randint(1, 60)
        groups = np.array([rng.randint(0, 3) for _ in range(n)])
        rows = np.array([[rng.choice([97, 98]) if rng.random() < 0.1 else 97 for _ in range(24)] for _ in range(n)], np.uint8)
        order, common = deep_shallow(groups, rows, rng.choice([1, 2, 3]))
        keys = [(groups[i], rows[i].tobytes()) for i in order]
        assert keys == sorted(keys)
        for (g, a), (h, b), c in zip(keys, keys[1:], common[1:]):
            assert c == (-1 if g != h else next((i for i in range(24) if a[i] != b[i]), 24))


@pytest.mark.parametrize("seed, hot, broadcast", [(1, 20, 10**6), (2, 10**6, 10**6), (3, 0, 0)])
def test_against_brute_force(spark, monkeypatch, seed, hot, broadcast):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    monkeypatch.setattr(suffix_dedup, "BUFFER", 5_000)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", broadcast)
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.choice([30, 49, 50, 51, 60, 120, 300]))) for _ in range(12)] + ["a" * 200, "ab" * 90]
    rows = []
    for i in range(200):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(1000 + i, rows[7][1]) for i in range(30)]
    got = found(documents(spark, [(*r, "s") for r in rows]))
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 1000


def test_odd_rows(spark):
    rows = [(i, t[:3000] if t else t, s) for i, t, s in odd_rows()]
    assert found(documents(spark, rows)) == brute([r[:2] for r in rows])
    assert cut(documents(spark, rows).limit(0)).count() == 0
