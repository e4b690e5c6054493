import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placewright.llm import hard_negatives as module
from placewright.llm import oracles
from placewright.llm.hard_negatives import Candidates, Query, encode, hard_negatives, integer_rows
from placewright.llm.queries import changed_label
from tests.compare import normalised

SCHEMA = "vec_id long, embedding array<float>, label int, hash long, v string, width int, norm int"


def some_rows(n=900, width=24, seed=1, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((10, width))
    rows = []
    for i in range(n):
        label = int(rng.integers(0, 10))
        vector = centres[label] * spread + rng.standard_normal(width)
        rows.append((i, [float(np.float32(x)) for x in vector / np.linalg.norm(vector)], label))
    return rows


def plain(rows, low=30, high=90):
    """Brute force by the rules."""
    took = {}
    for i, vector, label in rows:
        if None in (i, vector, label) or any(x is None or not np.isfinite(x) for x in vector):
            continue
        changed = (label + 1) % 10 if i % 7 == 0 else label
        took[i, changed, tuple(int(np.floor(float(x) * 256)) for x in vector)] = None
    out = []
    for i, label, v in took:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in took if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:5]:
            fits = sorted((t, k) for t, k, other in scored if other != label and low * -s <= -100 * t <= high * -s)
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(fits[:10], 1)]
    return pd.DataFrame(out, columns=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def found(spark, rows):
    table = spark.createDataFrame([(*r, 1, "v", 2, 3) for r in rows], SCHEMA)
    return hard_negatives(table, changed_label()).toPandas()


def odd_rows():
    rows = some_rows(260, 8, seed=3)
    same = [0.5, 0.25, -0.5, 0.125, 0.0, 0.0, 0.25, 0.5]
    rows += [(1000 + i, same, i % 3) for i in range(40)]  # ties everywhere
    rows += [(2000, same, 1), (2000, same, 1), (2000, same[::-1], 1), (2001, same, 1)]
    rows += [(None, same, 1), (2100, None, 1), (2200, same, None), (2300, [*same[:7], float("nan")], 1), (2400, [*same[:7], float("inf")], 2)]
    rows += [(2500, [*same[:7], None], 2), (2600, [], 3), (2601, [], 3), (2602, [], 4), (2700, [0.0] * 8, 5), (2701, [0.0] * 8, 5)]
    rows += [(-100, same, 2), (2800, [0.1] * 3, 2), (2801, [0.2] * 3, 2), (2802, [0.05] * 3, 7)]
    return rows


@pytest.mark.parametrize("rows", [some_rows(), some_rows(500, 70, 2, 0.0), odd_rows()], ids=["clusters", "wide", "odd"])
def test_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(module, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(module, "CANDIDATE_CHUNK", 200)
    got, expected = found(spark, rows), plain(rows)
    assert normalised(got) == normalised(expected) and len(got)


def test_oracle():
    rows = odd_rows()
    connection = duckdb.connect()
    connection.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    connection.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert normalised(connection.execute(oracles.HARD_NEGATIVES).df()) == normalised(plain(rows))


def test_intervals_hold_and_candidates_go():
    rng = random.Random(4)
    rows = some_rows(3000, 64, seed=5, spread=0.0)
    v = np.array([[int(np.floor(x * 256)) for x in r[1]] for r in rows])
    codes, align, rest = encode(v)
    table = Candidates.__new__(Candidates)
    table.ids, table.v, table.codes, table.align, table.rest = np.arange(len(v)), v, codes, align, rest
    table.norm, table.largest = np.sqrt((v.astype(float) ** 2).sum(1)), float(np.abs(v).max())
    scored = 0
    for i in rng.sample(range(len(v)), 40):
        exact = v @ v[i]
        others = np.flatnonzero(np.arange(len(v)) != i)
        least, most = 0.3 * np.sort(exact[others])[-1], 0.9 * np.sort(exact[others])[-1]
        at, scores = Query(v[i]).best(table, others, [(least, most)], 10)
        scored += len(at)
        inside = others[(exact[others] >= least) & (exact[others] <= most)]
        best = inside[np.argsort(-exact[inside], kind="stable")][:10]
        assert set(best) <= set(at) and (exact[at] == scores).all()
    assert scored < 0.1 * 40 * len(v)  # the codes decide about nine of ten


def test_no_rows(spark):
    assert len(found(spark, [])) == 0
    assert len(found(spark, [(0, [0.1, 0.2], 1)])) == 0
    empty = integer_rows(spark.createDataFrame([], SCHEMA), F.col("label"))
    assert empty.count() == 0
