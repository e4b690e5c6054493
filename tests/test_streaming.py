"""Tagging of arriving mentions, and the provenance record."""

import pytest
from pyspark.sql import functions as F

from placewright import tag, tag_stream
from placewright.plans.reports import data_date, provenance
from placewright.sources.mentions import read_mention_stream, read_mentions


@pytest.mark.parametrize("mode", ["find", "starts_with", "fuzzy", "levenshtein"])
def test_stream_equals_batch(spark, gazetteer, tmp_path, mode):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    options = {"mode": mode, "selection": "all"}

    def arrive(name, *lines):
        (source / name).write_text("".join(f"{line}\n" for line in lines), encoding="utf-8")
        stream = read_mention_stream(spark, str(source))
        tag_stream(stream, gazetteer, out, checkpoint, **options).awaitTermination()

    arrive("1.json", '{"reference": 1, "text": "Frankfurt"}', '{"reference": "2", "text": "none"}')
    arrive("2.json", '{"reference": 1, "text": "Frankfort"}', '{"reference": 3, "text": "Feldberg"}')
    streamed = spark.read.parquet(out).drop("batch")
    batch = tag(read_mentions(spark, str(source)), gazetteer, **options)
    as_text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct("*"))).collect())
    assert as_text(streamed) == as_text(batch)
    assert streamed.count() > 0


def test_provenance(spark, tmp_path):
    def comment(*arguments):
        return provenance(spark, *arguments).first().comment

    assert comment("2024-05-01", ["", "de"]) == "GeoNames Date: 2024-05-01; Languages: '', 'de'"
    assert comment("2024-05-01") == "GeoNames Date: 2024-05-01"
    assert comment(None, ["de"]) == "Languages: 'de'"
    assert comment() == ""
    table = spark.createDataFrame([("fr",), ("de",), ("fr",)], "lang string")
    row = provenance(spark, None, table).first()
    assert row.comment == "Languages: 'de', 'fr'"
    assert abs(row.timestamp - spark.range(1).select(F.unix_timestamp()).first()[0]) < 60
    (tmp_path / "date.txt").write_text(" 2024-05-01 \n\n")
    assert data_date(spark, str(tmp_path / "date.txt")) == "2024-05-01"
