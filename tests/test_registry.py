"""The registered queries against their oracles, on the smallest tables if they are there."""

import os

import pytest

import __spark_entry__ as registry
from tests.compare import connect, normalised

SF_DIR = "/root/testdata/sf0.001"
CHEAP = [
    "scan_places",
    "compressed_scan",
    "lenient_float",
    "places_last_wins",
    "posting_lists",
    "starts_with",
    "regex_word",
    "tag_levenshtein_first",
    "tag_words_levenshtein_first",
    "stream_tag_find",
    "result_json",
]


def test_oracles_belong_to_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("key", CHEAP)
def test_query(spark, key):
    ours = registry.queries()[key](spark, SF_DIR).toPandas()
    theirs = connect(SF_DIR).execute(registry.oracle_sql()[key]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normalised(ours) == normalised(theirs)
    assert len(ours)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_entry(spark):
    assert registry.entry(spark).count() > 0
