"""A saved gazetteer: the same results as one made from its files, without shuffling its tables."""

import re

import pytest
from pyspark.sql import functions as F

from placewright import Gazetteer, find, tag, tag_stream
from placewright.operators import joins
from placewright.plans import saved

MODES = [("find", 0), ("starts_with", 0), ("starts_with", 3), ("fuzzy", 0), ("fuzzy", 1), ("levenshtein", 1), ("levenshtein", 2)]


@pytest.fixture(scope="module")
def built(spark, dumps):
    return Gazetteer.build(spark, str(dumps / "places.txt"), str(dumps / "alternates.txt"))


@pytest.fixture(scope="module")
def mentions(spark, built):
    names = [r.term for r in built.terms.select("term").distinct().collect()]
    texts = names + [n[:-1] for n in names] + [n[1:] + "x" for n in names] + ["", "zz", None] + [n[::2] for n in names]
    return spark.createDataFrame(list(enumerate(texts)), "reference long, text string")


def rows(tagged):
    return sorted(r[0] for r in tagged.select(F.to_json(F.struct("*"))).collect())


@pytest.mark.parametrize("selection", ["first", "all"])
@pytest.mark.parametrize(("mode", "k"), MODES)
def test_same_results(built, gazetteer, mentions, mode, k, selection):
    options = {"mode": mode, "selection": selection, "max_dist": k}
    assert rows(tag(mentions, gazetteer, **options)) == rows(tag(mentions, built, **options))


def test_filtered_results_do_not_take_saved_tables(built, gazetteer, mentions):
    options = {"mode": "levenshtein", "selection": "first", "feature_class": "P"}
    assert rows(tag(mentions, gazetteer, **options)) == rows(tag(mentions, built, **options))


def test_another_session_declares_the_tables(spark, gazetteer, mentions):
    """Without the catalogue entries of the session that saved, the same files are buckets again."""
    path = re.sub(r"/[^/]*$", "", gazetteer.terms.inputFiles()[0]).removesuffix("/terms")
    loaded = Gazetteer.load(spark, path)  # by another name of the path
    assert set(loaded.tables) == set(gazetteer.tables)
    assert rows(tag(mentions, loaded, "levenshtein")) == rows(tag(mentions, gazetteer, "levenshtein"))
    assert not shuffled(tag(mentions, loaded, "find"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(df):
    """Bucketed tables of the plan that are exchanged before they are joined."""
    lines, found = plan_of(df).splitlines(), []
    depth = [len(line) - len(line.lstrip(" :+-|")) for line in lines]
    for i, line in enumerate(lines):
        table = re.search(r"FileScan parquet \S*placewright_[0-9a-f]+_(\w+)\[", line)
        if not table:
            continue
        level = depth[i]
        for j in range(i - 1, -1, -1):
            if depth[j] < level:
                level = depth[j]
                if "Join" in lines[j] or "Union" in lines[j]:
                    break
                if re.search(r"\bExchange\b", lines[j]):
                    found.append(table[1])
                    break
    return found


@pytest.mark.parametrize("mode", ["find", "starts_with", "levenshtein"])
def test_gazetteer_is_not_shuffled(spark, gazetteer, mentions, mode):
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in off}
    for key, value in off.items():
        spark.conf.set(key, value)
    try:
        tagged = tag(mentions, gazetteer, mode, "first")
        plan = plan_of(tagged)
        assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan
        assert not shuffled(tagged)
        assert "_best" in plan or "_prefixes" in plan
        assert ("deletions" in plan) == (mode == "levenshtein")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_batches_of_a_stream_make_no_keys(spark, gazetteer, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(joins, "keyed_terms", lambda *a: made.append(a))
    source = tmp_path / "in"
    source.mkdir()
    for i in range(2):
        (source / f"{i}.json").write_text('{"reference": %d, "text": "Frankfort"}\n' % i)
        stream = spark.readStream.schema("reference long, text string").json(str(source))
        options = {"mode": "levenshtein", "selection": "first"}
        tag_stream(stream, gazetteer, str(tmp_path / "out"), str(tmp_path / "cp"), **options).awaitTermination()
    assert not made and spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_missing_term_reads_no_row_group(spark, tmp_path):
    """Bloom filters: the ends of a row group's terms would let a term between them pass."""
    raw = spark.range(40_000).select(
        F.col("id").cast("string").alias("id"),
        F.concat(F.lit("name "), F.sha2(F.col("id").cast("string"), 256)).alias("name"),
        F.lit("").alias("ascii_name"),
        *[F.lit("").alias(c) for c in ("latitude", "longitude", "feature_class", "feature_code", "country_code")],
        *[F.lit("").alias(c) for c in ("adm1", "adm2", "adm3", "adm4", "elevation")],
        F.lit(0).alias("file_no"),
        F.lit(0).alias("block"),
        F.col("id").alias("row"),
    )
    kept = Gazetteer.from_raw(raw).save(str(tmp_path / "g"), distances=(), prefixes=False)
    name = kept.terms.select("term").first().term
    assert find(kept, name).count() == 1 and find(kept, name + "0").count() == 0
    assert set(kept.tables) == {saved.PLACES, saved.BEST}
    def rows_read(term):
        read = kept.terms.where(F.col("term") == term).select("term")
        read.collect()
        return read._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    assert rows_read(name[:-1] + "~") == 0 and rows_read(name) > 0
