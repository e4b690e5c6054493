import random
import re

import numpy as np
import pytest

from placewright.llm import jaccard_join
from placewright.llm.components import components
from placewright.llm.jaccard_join import join_documents, one_of_each
from tests.llm.helpers import documents, odd_rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """Sets, and components of rows; rows of one id count as linked."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        k = min(4, len(words))
        sets.append({tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [-(2**63) if i is None else i for i, _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and (ids[i] == ids[j] or 100 * both >= 85 * (len(a) + len(sets[j]) - both)):
                parent[root(i)] = root(j)
    least = {}
    for i, doc_id in enumerate(ids):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    clean = lambda i: None if i == -(2**63) else i
    return sorted(((clean(d), len(s), clean(least[root(i)]) if s else clean(d)) for i, (d, s) in enumerate(zip(ids, sets))), key=repr)


def found(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in join_documents(docs).collect()), key=repr)


@pytest.mark.parametrize("seed, broadcast, large", [(1, 10**6, 32), (2, 0, 4)])
def test_against_brute_force(spark, monkeypatch, seed, broadcast, large):
    monkeypatch.setattr(jaccard_join, "SAMPLE_ROWS", 50)
    monkeypatch.setattr(jaccard_join, "BLOCK", 300)
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    monkeypatch.setattr(jaccard_join, "PARTNERS", 5)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", broadcast)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rng.choices(vocabulary, k=rng.choice([0, 1, 3, 5, 30, 60, 200])) for _ in range(25)]
    rows = []
    for i in range(300):
        words = list(rng.choice(base if rng.random() < 0.6 else base[-1:]))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            if words:
                words[rng.randrange(len(words))] = rng.choice([*vocabulary, f"Q{rng.randrange(1000)}"])
        rows.append((i, None if rng.random() < 0.02 else " ".join(words)))
    docs = documents(spark, [(*r, "s") for r in rows])
    expected = brute(rows)
    assert found(docs) == expected
    kept = {r.doc_id for r in one_of_each(docs).collect()}
    assert kept == {i for i, _, c in expected if i == c}


def test_odd_rows(spark):
    docs = documents(spark, odd_rows())
    assert found(docs) == brute([r[:2] for r in odd_rows()])
    kept = one_of_each(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    # 5 goes as a copy of 4, 6 as one of the null id, 8 as similar to 7
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 7, 9, 10]
    assert join_documents(docs.limit(0)).count() == 0 and one_of_each(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {v: v for e in edges for v in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert {v: c for v, c in got.items()} == {v: root(v) for v in parent if any(v in e for e in edges if e[0] != e[1])}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_takes_five_words_and_four_fifths(spark):
    import corpus_pipeline

    rng = random.Random(8)
    rows, kept = [], set()
    # 96 shingles of five words; a tail of new words leaves 96 - tail of them: 80 % are alike up to a tail of 10
    for i, tail in enumerate([0, 6, 8, 9, 10, 11, 12, 20]):
        words = [f"w{rng.getrandbits(40)}" for _ in range(100)]
        rows += [(2 * i, " ".join(words), "s"), (2 * i + 1, " ".join(words[: 100 - tail] + [f"t{rng.getrandbits(40)}" for _ in range(tail)]), "s")]
        kept |= {2 * i, *([2 * i + 1] if 5 * (96 - tail) < 4 * (96 + tail) else [])}
    docs = documents(spark, rows)
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == kept
    assert {r.doc_id for r in one_of_each(docs).collect()} > kept


@pytest.mark.parametrize("share", [0, 0.5, 1])
def test_frequent_shingles_change_no_result(spark, monkeypatch, share):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [rng.choices(vocabulary, k=rng.choice([5, 30, 80])) for _ in range(8)]
    rows = []
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    shingles = np.unique(np.concatenate(list(jaccard_join.Shingles().sets([text for _, text in rows]))))
    chosen = shingles[np.random.default_rng(3).random(len(shingles)) < share]
    monkeypatch.setattr(jaccard_join, "frequent_shingles", lambda *_: chosen)
    assert found(documents(spark, [(i, text, "s") for i, text in rows])) == brute(rows)
