"""Every batch join against comparing all texts with all terms."""

import random

import pytest
from pyspark.sql import functions as F

from placewright import Gazetteer, tag
from placewright.operators import joins
from placewright.schema import MAIN_COLUMNS, MATCH_TYPES
from tests import brute

MODES = [("find", 0), ("starts_with", 0), ("starts_with", 2), ("fuzzy", 0), ("fuzzy", 1), ("fuzzy", 2)]
MODES += [("levenshtein", k) for k in range(4)]


def random_strings(rng, n, alphabet, longest):
    return ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(n)]


def template_strings(rng, n):
    return [f"Town hall of the parish of St. {rng.randint(0, 60):04d} in the county" for _ in range(n)]


def world(seed):
    rng = random.Random(seed)
    names = random_strings(rng, 60, "abä", 6) + random_strings(rng, 30, "aФü中", 4) + template_strings(rng, 25)
    names += [name + rng.choice("xyä") for name in rng.sample(names, 30)] + ["the same"] * 20
    texts = rng.sample(names, 60) + random_strings(rng, 30, "abäü", 4) + ["", "a", "ä", "zz"]
    for name in rng.sample(names, 30):
        at = rng.randint(0, len(name))
        texts.append(name[:at] + rng.choice("abФ") + name[at + rng.randint(0, 1) :])
    mentions = [(rng.randint(0, 20), text) for text in texts]
    return names, mentions


@pytest.fixture(scope="module", params=[1])
def case(request, spark, tmp_path_factory):
    names, mentions = world(request.param)
    ascii_names = [n.replace("ä", "a").replace("ü", "u") for n in names]
    raw = spark.createDataFrame(
        [(str(i), n, a, "P" if i % 3 else "T") for i, (n, a) in enumerate(zip(names, ascii_names, strict=True))],
        "id string, name string, ascii_name string, feature_class string",
    )
    have = set(raw.columns)
    raw = raw.select(
        *[F.col(c) if c in have else F.lit("").alias(c) for c in MAIN_COLUMNS],
        F.lit(0).alias("file_no"),
        (F.col("id").cast("long") / 50).cast("long").alias("block"),
        F.col("id").cast("long").alias("row"),
    )
    gazetteer = Gazetteer.from_raw(raw).save(str(tmp_path_factory.mktemp("world") / "gazetteer"))
    terms = []
    for i, (name, ascii_name) in enumerate(zip(names, ascii_names, strict=True)):
        if ascii_name != name:
            terms.append((ascii_name, 1, i))
        terms.append((name, 0, i))
    table = spark.createDataFrame(mentions, "reference long, text string")
    return gazetteer, table, [t for t in terms if t[0]], mentions


def rows(tagged):
    return sorted(
        (r.reference, r.key.name, MATCH_TYPES.index(r.key.type), r.key.id, r.distance)
        for r in tagged.collect()
    )


@pytest.mark.parametrize(("mode", "k"), MODES)
def test_all(case, mode, k):
    gazetteer, table, terms, mentions = case
    assert rows(tag(table, gazetteer, mode, "all", k)) == brute.tagged(mode, "all", mentions, terms, k)


@pytest.mark.parametrize(("mode", "k"), MODES)
def test_first(case, mode, k):
    gazetteer, table, terms, mentions = case
    expected = brute.tagged(mode, "first", mentions, terms, k)
    assert rows(tag(table, gazetteer, mode, "first", k)) == expected
    few = brute.tagged(mode, "first", mentions, terms, k, lambda place_id: place_id % 3 == 0)
    assert rows(tag(table, gazetteer, mode, "first", k, feature_class="T")) == few


def test_rank(case):
    gazetteer, table, _, _ = case
    every = tag(table, gazetteer, "levenshtein", "all", 1, rank=True)
    first = tag(table, gazetteer, "levenshtein", "first", 1)
    assert rows(every.filter("rank = 1").drop("rank")) == rows(first)


def pair_rows(pairs):
    return {(r.text, r.term, r.distance) for r in pairs.collect()}


@pytest.fixture
def sides(spark):
    names, mentions = world(3)
    texts = sorted({text for _, text in mentions})
    terms = sorted(set(names) - {""})
    both = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(
        [(t,) for t in terms], "term string"
    )
    return *both, texts, terms


@pytest.mark.parametrize("hot", [4096, 3], ids=["cold", "hot"])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_long_strings(monkeypatch, sides, k, hot):
    """Segment keys for all but the shortest terms, with and without hot segments."""
    monkeypatch.setattr(joins, "MAX_DELETION_KEYS", 1)
    monkeypatch.setattr(joins, "HOT_KEY_TERMS", hot)
    texts, dictionary, text_list, term_list = sides
    found = pair_rows(joins.levenshtein_pairs(texts, dictionary, k))
    assert found == brute.pairs("levenshtein", text_list, term_list, k)


@pytest.mark.parametrize(("few", "most", "broadcast"), [(4096, 8, 10**6), (3, 8, 10**6), (0, 3, 0), (0, 1, 0), (1, 12, 0)])
def test_subsequences(monkeypatch, sides, few, most, broadcast):
    """Keys of one pair of bytes, and of as many as there are."""
    monkeypatch.setattr(joins, "FEW_TERMS", few)
    monkeypatch.setattr(joins, "FEW_TEXTS", few)
    monkeypatch.setattr(joins, "MAX_PAIRS", most)
    monkeypatch.setattr(joins, "MAX_BROADCAST_KEYS", broadcast)
    texts, dictionary, text_list, term_list = sides
    assert pair_rows(joins.subsequence_pairs(texts, dictionary)) == brute.pairs("fuzzy", text_list, term_list, 0)


def test_subsequence_candidates_grow_with_results(spark, monkeypatch):
    """Four times the texts and terms: a join on one common key would make sixteen times the pairs.

    That is how it grows up to the number of texts that a key may have, so this number is 0 here.
    """
    monkeypatch.setattr(joins, "FEW_TEXTS", 0)
    met = []
    spied = joins.on_keys
    monkeypatch.setattr(joins, "on_keys", lambda *a: met.append(spied(*a)) or met[-1])
    sizes = []
    for n in (2_000, 8_000):
        name = F.concat(F.lit("Hall "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12))
        terms = spark.range(n).select(name.alias("term"))
        texts = terms.select(F.concat(F.substring("term", 1, 9), F.substring("term", 12, 5)).alias("text"))
        met.clear()
        results = joins.subsequence_pairs(texts, terms).count()
        sizes.append((sum(m.count() for m in met), results))
    (candidates, results), (more_candidates, more_results) = sizes
    assert more_results >= 4 * results * 0.9
    assert more_candidates < 6 * candidates and more_candidates < 300 * more_results


def test_pairs_come_once(sides):
    texts, dictionary, _, _ = sides
    for pairs in (joins.exact_pairs(texts, dictionary), joins.prefix_pairs(texts, dictionary, 0, 80)):
        assert pairs.count() == pairs.distinct().count()


@pytest.mark.parametrize("mode", ["starts_with", "fuzzy", "levenshtein"])
def test_plans_have_no_all_pairs_join(case, mode):
    gazetteer, table, _, _ = case
    for selection in ("first", "all"):
        plan = tag(table, gazetteer, mode, selection, 2)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan
        assert "Cartesian" not in plan


def test_partitioning_does_not_matter(spark, case):
    gazetteer, table, terms, mentions = case
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        found = rows(tag(table.repartition(5), gazetteer, "levenshtein", "first", 2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == brute.tagged("levenshtein", "first", mentions, terms, 2)


@pytest.mark.parametrize(("k", "most"), [(1, 1.0), (2, 1.01)])
def test_codes_of_one_form_meet_neighbours_only(spark, k, most):
    """Dense codes share what deletions leave with thousands that are twice as far away."""
    codes = spark.range(1, 3000).select(F.format_string("Customer#%09d", "id").alias("term"))
    texts = codes.where("term like '%7'").withColumnRenamed("term", "text")
    met = joins._edit_candidates(texts, codes, k, 18).select("text", "term").distinct().count()
    results = joins.once(joins.levenshtein_pairs(texts, codes, k, 18)).count()
    assert results <= met <= most * results
