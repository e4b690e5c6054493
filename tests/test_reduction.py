"""Rows that cannot win are gone before the aggregates, and the winners are the same."""

import random

import pytest
from pyspark.sql import functions as F

from placewright import Gazetteer, find
from placewright.operators import reduction
from placewright.operators.reduction import leaders, without_beaten
from placewright.operators.terms import last_rows, place_records
from placewright.plans.saved import best_postings
from placewright.plans.tagging import _leading
from placewright.schema import MAIN_COLUMNS

WORDS = ["la", "été", "the", "a", "pont", "", "rare"]


@pytest.fixture(scope="module")
def raw(spark):
    """Words of documents: many rows of an id, and of a word."""
    rng = random.Random(3)
    rows = [
        (str(doc), rng.choice(WORDS) if at else f"once{doc}", doc // 7, at)
        for doc in range(60)
        for at in range(rng.randint(1, 40))
    ]
    rows += rows[:50]  # rows that come twice
    df = spark.createDataFrame(rows, "id string, name string, block long, row long").withColumn("file_no", F.lit(0))
    given = {"id": "id", "name": "name", "country_code": "row"}
    columns = [(F.col(given[c]) if c in given else F.lit("")).cast("string").alias(c) for c in MAIN_COLUMNS if c != "ascii_name"]
    return df.select(*columns, F.translate("name", "é", "e").alias("ascii_name"), "file_no", "block", "row").repartition(5)


def rows(df):
    return sorted(map(repr, df.collect()))  # latitudes may be NaN, which equals nothing


def test_places(raw):
    few = last_rows(raw)
    assert few.count() < raw.count() / 5 and few.schema.names == raw.schema.names
    assert rows(place_records(few)) == rows(place_records(raw))
    gazetteer = Gazetteer.from_raw(raw)
    assert rows(gazetteer.entries()) == rows(gazetteer.places)
    assert find(gazetteer, "été").select("entry").distinct().count() == find(gazetteer, "été").select("key.id").distinct().count()


@pytest.mark.parametrize("most", [1_000_000, 3, 0])
def test_postings(raw, monkeypatch, most):
    monkeypatch.setattr(reduction, "MAX_TEXTS", most)
    gazetteer = Gazetteer.from_raw(raw)
    whole = best_postings(gazetteer.terms)
    for insertion_order, chosen in ((True, "earliest"), (False, "least")):
        few = _leading(gazetteer, insertion_order, {})
        assert (few.count() < gazetteer.terms.count() / 4) == (most > 10)
        assert rows(best_postings(few).select("term", chosen)) == rows(whole.select("term", chosen))
    assert gazetteer.longest_term() == max(len(r["term"]) for r in whole.collect())


def test_null_keys_and_ties_stay(spark):
    df = spark.createDataFrame([(None, 1, "a")] * 9 + [("x", 1, "b")] * 9 + [("x", 2, "c")] * 9, "k string, o int, v string")
    left = without_beaten(df, "k", ["o"], leaders(df, "k", ["o"]))
    assert sorted(map(tuple, left.groupBy("v").count().collect())) == [("a", 9), ("b", 9)]
