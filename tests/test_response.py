"""Results and provenance as one: readers see both or neither."""

import os

import pytest
from pyspark.sql import functions as F

from placewright import tag
from placewright.plans.reports import provenance
from placewright.sources.dumps import list_files
from placewright.sources.results import read_response, write_response


@pytest.fixture(scope="module")
def results(spark, gazetteer):
    mentions = spark.createDataFrame([(1, "Frankfurt"), (2, "none")], "reference long, text string")
    return tag(mentions, gazetteer, selection="all")


def test_both(spark, results, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        read_response(spark, path)
    response = write_response(results, provenance(spark, "2024-05-01", ["de"]), path)
    assert response.results.count() == results.count() > 0
    assert response.provenance.first().comment == "GeoNames Date: 2024-05-01; Languages: 'de'"
    assert os.listdir(tmp_path) == ["out"]
    with pytest.raises(FileExistsError):
        write_response(results, provenance(spark), path)
    assert read_response(spark, path).results.count() == results.count()


def test_neither(spark, results, tmp_path):
    path = str(tmp_path / "out")
    broken = provenance(spark).withColumn("comment", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        write_response(results, broken, path)
    assert os.listdir(tmp_path) == []


def test_listing_of_many_files(spark, tmp_path):
    names = ["b c.txt", "a;x=1.txt", "d.gz", "é+%20.txt"] + [f"n{i:04d}.txt" for i in range(1500)]
    for name in names:
        (tmp_path / name).write_text("x")
    (tmp_path / "folder").mkdir()
    (tmp_path / "_SUCCESS").write_text("")
    found = list_files(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[-1] for f in found] == sorted(names)
    (tmp_path / "_data").write_text("x")
    with pytest.raises(ValueError, match="underscore"):
        list_files(spark, str(tmp_path))
