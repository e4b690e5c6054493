import os
import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as registry
import corpus_pipeline
from placewright.llm import oracles, queries
from placewright.llm.pieces import MODEL, Pieces
from placewright.llm.toxicity import fit
from tests.compare import connect, normalised
from tests.llm import test_line_dedup, test_pieces
from tests.llm.helpers import documents, noisy, odd_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, key):
    ours = queries.queries()[key](spark, SF_DIR).toPandas()
    theirs = connect(SF_DIR).execute(queries.oracle_sql()[key]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and normalised(ours) == normalised(theirs) and len(ours)


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in queries.queries()}
    assert set(queries.queries()) | {"pipeline"} <= set(registry.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark, odd_rows())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.schema.simpleString() == docs.schema.simpleString()
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert last and all(r.intact for r in last)


def first_of_each(rows):
    """Plain near-duplicate stage: sets of five words, 0.8 alike, one document of each component."""
    sets = []
    for _, text in rows:
        words = [w.lower() for w in text.split()]
        k = min(5, len(words))
        sets.append({tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set())
    component = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both) and component[i] != component[j]:
                gone = component[i]
                component = [component[j] if c == gone else c for c in component]
    least = {}
    for (doc_id, _), c in zip(rows, component, strict=True):
        least[c] = min(least.get(c, doc_id), doc_id)
    return [(i, t) for (i, t), c in zip(rows, component, strict=True) if least[c] == i]


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model")
def test_against_a_plain_version(spark, tmp_path):
    """run() on a small table, and each stage in plain Python or SQL one after the other."""
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("lo", "ma", "ri", "tu", "sen", "da") for b in ("ba", "ke", "mi", "no", "pu", "tar")]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [line(8) for _ in range(6)]
    base = [line(120) for _ in range(12)]
    rows, labels = [], []
    for i in range(260):
        toxic = rng.random() < 0.25
        body = rng.choice(base) if rng.random() < 0.4 else line(rng.randint(8, 40))
        words = noisy(rng, body.split(), vocabulary, rng.choice([0, 1, 2, 2]))
        if toxic:
            for _ in range(4):
                words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "scum", "trash"]))
        lines = [" ".join(words), *([rng.choice(shared)] if rng.random() < 0.3 else [])]
        rows.append((i, "\n".join(lines), rng.choice(["a", "a", "b", "c", None])))
        labels.append((i, int(toxic)))
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = fit(docs, marks)
    source = {i: s for i, _, s in rows}
    kept = [(i, t) for i, t, _ in rows if model.score(t) < 0.5]
    thinned = test_line_dedup.brute(kept)
    single = first_of_each([(i, thinned[i][0]) for i, _ in kept])
    connection = duckdb.connect()
    table = pd.DataFrame([(i, t, source[i]) for i, t in single], columns=["doc_id", "text", "source"])
    connection.register("documents", table)
    mix = connection.execute(oracles.MIXING).df()
    times = {r.doc_id: int(r.taken / r.size + 0.5) for r in mix.itertuples() if r.taken}
    with open(MODEL, "rb") as file:
        pieces = Pieces(file.read())
    expected = [(i, test_pieces.whole(pieces, t)) for i, t in single for _ in range(times.get(i, 0))]
    assert len(rows) > len(kept) > len(single) > 20 and any(n for _, n in thinned.values())
    assert sorted((r.doc_id, list(r.ids)) for r in got) == sorted(expected)
    assert all(r.intact for r in got)
