import os
import random
import zlib

import numpy as np
import pytest

from placewright.llm.toxicity import dependence, label_model, score_documents, tree, without_toxic
from tests.llm.helpers import documents, odd_rows


def corpus(n=900, noise=0.0):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("lo", "ma", "ri", "tu", "sen", "da") for b in ("ba", "ke", "mi", "no", "pu", "tar")]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "scum", "vequ" + rng.choice(vocabulary), "Trash!"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic) if rng.random() >= noise else 1 - int(toxic), int(toxic)))
    return rows, labels


@pytest.mark.parametrize("noise", [0.0, 0.08])
def test_held_out_accuracy(spark, noise):
    rows, labels = corpus(noise=noise)
    marks = spark.createDataFrame([(i, given) for i, given, _ in labels], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_documents(documents(spark, rows), marks).collect()}
    truth = {i: true for i, _, true in labels}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97


def test_held_out_labels_are_never_used(spark):
    rows, labels = corpus(300)
    marks = [(i, given) for i, given, _ in labels]
    flipped = [(i, 1 - g if zlib.crc32(str(i).encode()) % 5 == 0 else g) for i, g in marks]
    scores = [
        {r.doc_id: r.score for r in score_documents(documents(spark, rows), spark.createDataFrame(m, "doc_id long, toxic int")).collect()}
        for m in (marks, flipped)
    ]
    assert scores[0] == scores[1]


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    rates = [(0.02, 0.6), (0.05, 0.5), (0.01, 0.4), (0.2, 0.3)]
    votes = np.column_stack([np.where(truth, rng.random(4000) < b, rng.random(4000) < a) for a, b in rates])
    votes = np.column_stack([votes, votes[:, 3]])  # a voter that repeats another
    posterior, found, weights = label_model(votes, votes[:, :3].any(1).astype(float) * 0.8 + 0.05)
    assert np.abs(found[:, :3] - np.array(rates[:3]).T).max() < 0.15
    assert weights[3] < 0.6 < weights[0]
    assert ((posterior > 0.5) == truth).mean() > 0.8


def test_odd_rows(spark):
    docs = documents(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in score_documents(docs, none).collect()} == {0}
    rows, labels = corpus(300)
    marks = spark.createDataFrame([(i + 100, given) for i, given, _ in labels] + [(None, 1), (100, None), (101, labels[1][1])], "doc_id long, toxic int")
    both = documents(spark, odd_rows() + [(i + 100, t, s) for i, t, s in rows])
    scored = score_documents(both, marks).collect()
    assert len(scored) == len(odd_rows()) + 300 and all(0 <= r.score <= 1 for r in scored)
    kept = without_toxic(both, marks)
    assert kept.schema.simpleString() == both.schema.simpleString()
    assert kept.count() == sum(r.predicted == 0 for r in scored)
    assert score_documents(docs.limit(0), marks.limit(0)).count() == 0


def test_tasks_without_rows(spark, tmp_path):
    """One row group read by several tasks, and a filter that leaves most of them without training rows."""
    rows, labels = corpus(400)
    path = str(tmp_path / "one")
    documents(spark, rows).coalesce(1).write.parquet(path)
    marks = spark.createDataFrame([(i, given) for i, given, _ in labels], "doc_id long, toxic int")
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "2k")
    try:
        docs = spark.read.parquet(path)
        assert docs.rdd.getNumPartitions() > 4
        scored = score_documents(docs, marks).collect()
        assert len(scored) == 400 and {r.predicted for r in scored} == {0, 1}
    finally:
        spark.conf.set(size, before)


def test_copies_of_a_voter_change_nothing():
    """Thirty copies of a poor voter do not outvote three good ones; taken for independent they would."""
    rng = np.random.default_rng(1)
    truth = rng.random(3000) < 0.2
    good = np.column_stack([np.where(truth, rng.random(3000) < 0.7, rng.random(3000) < 0.02) for _ in range(3)])
    poor = np.where(truth, rng.random(3000) < 0.4, rng.random(3000) < 0.3)
    start = good.any(1) * 0.8 + 0.1
    once, _, _ = label_model(np.column_stack([good, poor]), start)
    often, _, own = label_model(np.column_stack([good, np.tile(poor[:, None], 30)]), start)
    assert np.abs(once - often).mean() < 0.05 and ((often > 0.5) == truth).mean() > 0.93
    assert own[:3].min() > 0.8 > own[3:].max()


def test_tree_has_the_strongest_ties():
    rng = np.random.default_rng(2)
    a, c = rng.random((2, 4000)) < 0.4
    b, d = a ^ (rng.random(4000) < 0.05), c ^ (rng.random(4000) < 0.1)
    information, _ = dependence(np.column_stack([a, c, b, d]).astype(np.uint8), np.full(4000, 0.5))
    parents = tree(information)
    assert {frozenset((i, int(p))) for i, p in enumerate(parents) if p >= 0} == {frozenset((0, 2)), frozenset((1, 3))}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_rows_of_the_test_tables(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").dropna()
    scored = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    rows = scored.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) >= 0.85 and np.mean([r.predicted for r in clean]) <= 0.02
    above = np.mean([[t.score > c.score for c in clean] for t in toxic])
    assert above >= 0.92
