import random

import pytest

from placewright.llm import oracles
from placewright.llm.mixing import apportion, mix, mixed
from tests.compare import normalised
from tests.llm.helpers import documents, odd_rows

NAMES = ["doc_id", "size", "source_size", "target", "taken"]


def targets(sizes):
    """Shares by weight, capped at twice the size, the excess shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    most = {s: 2 * sizes[s] for s in order}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most[s]}
        for s in full or open_:
            target[s] = most[s] if full else weight[s] * level
        left -= sum(most[s] for s in full)
        open_ = open_ - full if full else set()
    return target


@pytest.mark.parametrize("shard_words", [1 << 20, 500])
def test_targets_and_quotas(spark, shard_words):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 80))), rng.choice(["a", "a", "a", "b", "c", None, ""])) for i in range(600)]
    rows = [(i, t, "d" if i == 5 else s) for i, t, s in rows]
    got = mix(documents(spark, rows), shard_words=shard_words).collect()
    again = mix(documents(spark, rows).repartition(5), shard_words=shard_words).collect()
    assert sorted(got) == sorted(again)
    source = {i: s for i, _, s in rows}
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    expected = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[s]
        assert r.target == pytest.approx(expected[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 17 + 16 * (sizes[s] // shard_words)


def test_apportionment_is_sainte_lague(spark):
    rng = random.Random(4)
    rows = [(g, p, rng.choice([0, 1, rng.randint(1, 50), rng.randint(1, 5000)]), house) for g, house in ((1, 7), (2, 1000), (3, 0)) for p in range(30)]
    frame = spark.createDataFrame(rows, "g long, party long, votes long, house long")
    got = {(r.g, r.party): r.seats for r in apportion(frame, ["g"], "votes", "house", [frame["party"]], "seats").collect()}
    for g, house in ((1, 7), (2, 1000), (3, 0)):
        quotients = sorted((-v / (2 * k + 1), p, k) for h, p, v, _ in rows if h == g and v for k in range(house))
        expected = dict.fromkeys(range(30), 0)
        for _, p, _ in quotients[:house]:
            expected[p] += 1
        assert {p: got[g, p] for p in range(30)} == expected


def test_odd_rows_against_sql(spark):
    import duckdb
    import pandas as pd

    rows = odd_rows()
    ours = mix(documents(spark, rows)).toPandas()
    table = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows], "source": [r[2] for r in rows]})
    connection = duckdb.connect()
    connection.register("documents", table)
    theirs = connection.execute(oracles.MIXING).df()
    assert list(ours.columns) == NAMES and normalised(ours) == normalised(theirs)


def test_mixed_documents(spark):
    docs = documents(spark, odd_rows())
    done = mixed(docs)
    assert done.schema.simpleString() == docs.schema.simpleString()
    assert all(r.text and r.text.strip() for r in done.collect())
    assert mixed(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0
    blank = documents(spark, [(1, None, "a"), (2, "", None)])
    assert [tuple(r)[1:] for r in mix(blank).collect()] == [(0, 0, 0.0, 0)] * 2
