"""Results on the hand-made gazetteer, in order."""

import math

import pytest

from placewright import Gazetteer, find, fuzzy, levenshtein, regex, starts_with, tag
from placewright.operators.terms import posting_lists
from placewright.plans.gazetteer import load_counters, search_pairs
from placewright.plans.reports import catalogue_stats
from placewright.sources.dumps import scan_alternates, scan_places
from tests.fixtures import TERMS

SEARCHES = {"find": find, "starts_with": starts_with, "fuzzy": fuzzy, "levenshtein": levenshtein, "regex": regex}


def rows(found):
    return [
        (r.key.name, r.key.type, r.key.id, *([r.distance] if "distance" in r else []))
        for r in found.collect()
    ]


F101, F104 = ("Frankfurt", "Name", 101), ("Frankfurt", "Name", 104)
F103, MAIN = ("Frankfort", "Name", 103), ("Frankfurt am Main", "PreferredName", 101)
FELDBERG = [
    ("Feldberg", "Name", 102),
    ("Großer Feldberg", "Name", 102),
    ("Grosser Feldberg", "AsciiName", 102),
    ("Feldberg", "Alternate", 102),
]


@pytest.mark.parametrize(
    ("mode", "arguments", "expected"),
    [
        ("find", {"query": "Frankfurt"}, [F101, F104]),
        ("find", {"query": "Frankfurt", "country_code": "US"}, [F104]),
        ("find", {"query": "frankfurt"}, []),
        ("find", {"query": "Lost"}, []),
        ("find", {"query": "Großer Feldberg", "feature_class": "T", "country_code": "DE"}, [FELDBERG[1]]),
        ("find", {"query": "Großer Feldberg", "feature_class": "P"}, []),
        ("find", {"query": "Frankfort", "feature_code": "PPLA"}, [F103]),
        ("find", {"query": "Feldberg"}, [FELDBERG[0], FELDBERG[3]]),
        ("starts_with", {"query": "Frankf"}, [(*F101, 3), (*F103, 3), (*F104, 3), (*MAIN, 11)]),
        ("starts_with", {"query": "Frankf", "max_dist": 3}, [(*F101, 3), (*F103, 3), (*F104, 3)]),
        ("starts_with", {"query": "Frankf", "max_dist": "2"}, []),
        ("fuzzy", {"query": "Frkfrt"}, [(*F101, 3), (*F103, 3), (*F104, 3), (*MAIN, 11)]),
        ("fuzzy", {"query": "Frkfrt", "max_dist": 3}, [(*F101, 3), (*F103, 3), (*F104, 3)]),
        ("fuzzy", {"query": "FrnkfraMain"}, [(*MAIN, 6)]),
        ("levenshtein", {"query": "Frxnkfxrt", "max_dist": 2}, [(*F101, 2), (*F103, 2), (*F104, 2)]),
        ("levenshtein", {"query": "Frxnkfxrt"}, []),
        ("levenshtein", {"query": "Frankfort"}, [(*F103, 0), (*F101, 1), (*F104, 1)]),
        ("levenshtein", {"query": "Frankfurt", "max_dist": 0}, [(*F101, 0), (*F104, 0)]),
        ("regex", {"pattern": "^Frankfurt.*"}, [F101, F104, MAIN]),
        ("regex", {"pattern": "Frank"}, []),
        ("regex", {"pattern": "Frank|Frankfurt"}, []),
        ("regex", {"pattern": "Frankfurt|Frank"}, [F101, F104]),
        ("regex", {"pattern": "berg"}, FELDBERG),
        ("regex", {"pattern": "berg", "feature_class": "P"}, []),
    ],
)
def test_search(gazetteer, mode, arguments, expected):
    assert rows(SEARCHES[mode](gazetteer, **arguments)) == expected
    by_rank = SEARCHES[mode](gazetteer, **arguments, rank=True).orderBy("rank")
    assert rows(by_rank) == expected
    assert [r["rank"] for r in by_rank.collect()] == list(range(1, len(expected) + 1))


@pytest.mark.parametrize("mode", SEARCHES)
def test_empty_query(gazetteer, mode):
    with pytest.raises(ValueError, match="empty"):
        SEARCHES[mode](gazetteer, "")


def terms_in_order(gaz):
    return [
        (r.term, r.type, r.id, r.lang, r["from"], r["to"]) for r in gaz.terms.orderBy("seq").collect()
    ]


def test_terms(gazetteer):
    assert terms_in_order(gazetteer) == TERMS


def test_all_languages(spark, dumps):
    gaz = Gazetteer.build(
        spark, str(dumps / "places.txt"), str(dumps / "alternates.txt"), all_languages=True
    )
    francfort = ("Francfort", "Alternate", 103, "fr", None, None)
    assert terms_in_order(gaz) == [*TERMS[:9], francfort, *TERMS[9:]]
    empty = Gazetteer.build(spark, str(dumps / "places.txt"), str(dumps / "alternates.txt"), languages=[])
    assert terms_in_order(empty) == terms_in_order(gaz)


def test_main_only(spark, dumps):
    assert terms_in_order(Gazetteer.build(spark, str(dumps / "places.txt"))) == TERMS[:6]


def test_places(gazetteer):
    places = {r.id: r for r in gazetteer.places.collect()}
    assert sorted(places) == [101, 102, 103, 104]
    assert (places[102].name, places[102].elevation, places[102].latitude) == ("Feldberg", 1493, 47.5)
    assert places[103].elevation is None
    assert places[104].elevation is None
    assert math.isnan(places[104].latitude)
    assert places[101].adm1 == ""


def test_statistics(spark, dumps, gazetteer):
    assert catalogue_stats(gazetteer).first().asDict() == {"n_places": 4, "n_terms": 9}
    main = scan_places(spark, str(dumps / "places.txt"))
    pairs = search_pairs(main, scan_alternates(spark, str(dumps / "alternates.txt")), ["", "de"])
    assert load_counters(pairs).first().asDict() == {"main_pairs": 6, "all_pairs": 11}


def test_posting_lists(gazetteer):
    lists = posting_lists(gazetteer.terms).orderBy("term", "position").collect()
    assert [(r.position, r.id) for r in lists if r.term == "Frankfurt"] == [(1, 101), (2, 104)]
    assert [(r.position, r.type) for r in lists if r.term == "Feldberg"] == [(1, "Name"), (2, "Alternate")]


def mentions(spark, *pairs):
    return spark.createDataFrame(list(pairs), "reference long, text string")


def tagged(results):
    return sorted((r.reference, r.key.name, r.key.type, r.key.id, r.distance) for r in results.collect())


def test_tag_find_first(spark, gazetteer):
    table = mentions(spark, (1, "Frankfurt"), (2, "Nirgendwo"), (3, "FFM"), (1, "Feldberg"))
    expected = [(1, "Feldberg", "Name", 102, 0), (1, *F101, 0), (3, "FFM", "ShortName", 101, 0)]
    assert tagged(tag(table, gazetteer)) == expected
    assert tagged(tag(table, gazetteer, country_code="US")) == [(1, *F104, 0)]


def test_tag_find_first_is_by_insertion(spark, gazetteer):
    # All results of a text in the rank column; the first one must be the head of all.
    table = mentions(spark, (1, "Feldberg"), (1, "Feldberg"))
    ranks = tag(table, gazetteer, selection="all", rank=True).orderBy("rank").collect()
    assert [(r["rank"], r.key.type) for r in ranks] == [(1, "Name")] * 2 + [(2, "Alternate")] * 2


def test_tag_empty_text(spark, gazetteer):
    table = mentions(spark, (1, ""))
    assert tagged(tag(table, gazetteer, "levenshtein", "all", 0)) == []
    assert tagged(tag(table, gazetteer, "find", "all")) == []
    assert [r[1] for r in tagged(tag(table, gazetteer, "levenshtein", "all", 3))] == ["FFM"]
    assert len(tagged(tag(table, gazetteer, "starts_with", "all"))) == 11
    assert len(tagged(tag(table, gazetteer, "fuzzy", "all"))) == 11


def test_tag_arguments(spark, gazetteer):
    with pytest.raises(ValueError, match="mode"):
        tag(mentions(spark, (1, "a")), gazetteer, "regex")
    with pytest.raises(ValueError, match="selection"):
        tag(mentions(spark, (1, "a")), gazetteer, "find", "last")
