"""All matches of all mentions: frequent texts are dealt to shares, whose number does not depend on bytes."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from placewright import tag
from placewright.plans import tagging


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(tagging, "SHARE_MENTIONS", 10)


def names(gazetteer):
    return sorted(r.term for r in gazetteer.terms.select("term").distinct().collect())


def results(tagged, *columns):
    return Counter(tuple(row) for row in tagged.select(*columns, F.to_json(F.struct("key", "entry", "distance"))).collect())


@pytest.mark.parametrize(("mode", "rank"), [("find", False), ("starts_with", False), ("levenshtein", True)])
def test_shares_lose_and_repeat_nothing(spark, gazetteer, few, mode, rank):
    columns = ["rank"] if rank else []
    texts = names(gazetteer)
    once = tag(spark.createDataFrame(list(zip(texts, texts, strict=True)), "reference string, text string"), gazetteer, mode, "all", rank=rank)
    rows = [(ref, text) for i, text in enumerate([*texts, None, "zz"]) for ref in [*range(3 * i), *[7] * i, None, None]]
    found = results(tag(spark.createDataFrame(rows, "reference long, text string"), gazetteer, mode, "all", rank=rank), "reference", *columns)
    expected = Counter()
    for (text, *rest), n in results(once, "reference", *columns).items():
        for ref in (ref for ref, asked in rows if asked == text):
            expected[ref, *rest] += n
    assert found == expected


def test_a_text_is_dealt_to_several_tasks(spark, gazetteer, few):
    text = names(gazetteer)[-1]
    mentions = spark.createDataFrame([(ref, text) for ref in range(400)], "reference long, text string").coalesce(1)
    tasks = tag(mentions, gazetteer, "starts_with", "all").groupBy(F.spark_partition_id().alias("task")).count()
    assert tasks.count() > 1


def test_a_join_holds_mentions_not_matches(spark, gazetteer):
    mentions = spark.createDataFrame([(1, "a")], "reference long, text string")
    node = tag(mentions, gazetteer, "starts_with", "all")._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    assert [side.output().mkString(",").count("reference#") for side in (node.children().apply(0), node.children().apply(1))] == [0, 1]
