import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest

from placewright.llm import conversation_trie, oracles
from placewright.llm.conversation_trie import grafted, op13_digest, trie
from tests.compare import normalised

SCHEMA = "conv_id long, turn long, role string, text string, depth int, f string, at int, base long, chars string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", 2, 3, "c") for r in rows], SCHEMA)


def plain(rows, graft=True):
    """All nodes by brute force over whole texts."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6 if graft else 0
        base = c - int(pd.Series([c]).map(lambda x: abs(x) % 100 * (1 if x >= 0 else -1)).iloc[0])
        rebuilt[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        out.append(
            (
                min(convs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs),
                children.get(node, 0),
                sum(n not in children for n in below),
                sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return pd.DataFrame(out, columns=COLUMNS)


def some_rows(seed, n=140, long=0):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-120, 900), n):
        for turn in range(rng.choice([1, 2, 3, 5, 7, 9])):
            rows.append((conv, turn, ["user", "assistant"][turn % 2], rng.choice(["hi", "é☃😀", "no", "", None, "longer text"])))
    rows += [(901, i, "user", "same") for i in range(long)] + [(902, i, "user", "same") for i in range(long // 2)]
    rows += [(5000, None, "user", "b"), (5000, None, None, "a"), (5000, 0, "user", "c"), (5000, 0, "user", "c"), (None, 0, "user", "lost")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = some_rows(seed)
    got = op13_digest(grafted(table(spark, rows)).nodes).toPandas()
    assert normalised(got) == normalised(plain(rows))


def test_oracle(spark):
    rows = some_rows(3, 60)
    connection = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    connection.register("conversations", frame)
    assert normalised(connection.execute(oracles.TRIE).df()) == normalised(plain(rows))


def test_long_conversations_go_in_blocks(spark, monkeypatch):
    """Three levels of blocks, several pieces of depths."""
    monkeypatch.setattr(conversation_trie, "BLOCK", 4)
    monkeypatch.setattr(conversation_trie, "DEPTHS", 8)
    monkeypatch.setattr(conversation_trie, "ID_BITS", 1)
    rows = some_rows(4, 30, long=70)
    got = op13_digest(grafted(table(spark, rows)).nodes).toPandas()
    assert normalised(got) == normalised(plain(rows))


def test_collisions_are_found_and_mended(spark):
    """With a small prime many prefixes share a fingerprint; other hashes are tried until none do."""
    rows = [(i, j, "user", f"{i * j % 3}") for i in range(6) for j in range(2)]
    got = op13_digest(trie(table(spark, rows), modulus=61).nodes).toPandas()
    assert normalised(got) == normalised(plain(rows, graft=False))


def test_nodes_refer_to_turns(spark):
    rows = some_rows(5, 30)
    found = grafted(table(spark, rows)).with_turns().collect()
    assert all((r.text is None) == (r.depth == 0) for r in found)
    first = {(r.role, r.text) for r in found if r.depth == 1}
    assert len(first) == sum(r.depth == 1 for r in found)


def test_no_rows(spark):
    assert grafted(table(spark, [])).nodes.count() == 0
    assert grafted(table(spark, [(None, 0, "user", "x")])).nodes.count() == 0
