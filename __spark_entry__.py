"""

The test tables are read as a gazetteer (``placewright.star_schema``): parts are places, customers
alternate names, orders and events mentions. All queries run over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright import Gazetteer, find, fuzzy, levenshtein, regex, starts_with, tag, tag_stream
from placewright import star_schema as star
from placewright.functions.matching import edit_distance
from placewright.functions.parsing import alternate_type, flag, lenient_float, lenient_smallint
from placewright.operators.terms import alternate_pairs, main_pairs, place_records, posting_lists
from placewright.plans.gazetteer import load_counters, search_pairs
from placewright.plans.reports import catalogue_stats, provenance
from placewright.schema import ALTERNATE_COLUMNS, MAIN_COLUMNS
from placewright.scratch import scratch_dir
from placewright.sources.dumps import scan_alternates, scan_places
from placewright.sources.mentions import read_mentions
from placewright.sources.results import as_json, read_response, write_response
from placewright.star_schema_sql import ORACLES

llm = corpus_pipeline = None
try:  # the only place that allows for the subpackage and its pipeline to be missing
    import placewright.llm.queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("placewright.llm", "placewright.llm.queries"):
        raise
if llm:
    try:
        import corpus_pipeline
    except ModuleNotFoundError as missing:
        if missing.name != "corpus_pipeline":
            raise

NAME = "small ring ECONOMY Brand#2"
LANGUAGES = ["building", "machinery", "automobile"]
DATA_DATE = "2024-01-01"
WORD_PATTERN = r"(?i)^é\p{L}+(tion|ment)"


def entry(spark: SparkSession) -> DataFrame:
    """Tag every order's mention with its best place within one edit."""
    return queries()["tag_levenshtein_first"](spark, "/root/testdata/sf0.001")


# --- shared pieces --------------------------------------------------------------------------------


def _gazetteer(spark: SparkSession, sf_dir: str) -> Gazetteer:
    return Gazetteer.from_raw(star.raw_places(spark, sf_dir), star.raw_alternates(spark, sf_dir), None)


def _saved(spark: SparkSession, sf_dir: str) -> Gazetteer:
    """The gazetteer as it is meant to be used: built and saved once, then read."""
    return _gazetteer(spark, sf_dir).save(scratch_dir(spark))


def _flat(results: DataFrame) -> DataFrame:
    """Results with scalar columns, as SQL engines compare them."""
    extra = [name for name in ("reference", "distance", "rank") if name in results.columns]
    return results.select(
        *extra,
        F.col("key.name").alias("name"),
        F.col("key.type").alias("type"),
        F.col("key.id").alias("id"),
        F.col("key.lang").alias("lang"),
        F.col("key.from").alias("valid_from"),
        F.col("key.to").alias("valid_to"),
        F.col("entry.name").alias("entry_name"),
        F.col("entry.latitude").cast("double").alias("latitude"),
        F.col("entry.longitude").cast("double").alias("longitude"),
        F.col("entry.feature_class").alias("feature_class"),
        F.col("entry.feature_code").alias("feature_code"),
        F.col("entry.country_code").alias("country_code"),
        F.col("entry.elevation").cast("int").alias("elevation"),
    )


def _search(function, *arguments, gazetteer=_gazetteer, rank=True, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(function(gazetteer(spark, sf_dir), *arguments, rank=rank, **options))

    return query


def _tag(mode: str, selection: str, gazetteer=_gazetteer, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        mentions = star.order_mentions(spark, sf_dir)
        return _flat(tag(mentions, gazetteer(spark, sf_dir), mode, selection, **options))

    return query


def _dump(raw: DataFrame, columns: list[str], compression: str = "none", n_files: int | None = None) -> str:
    """Write raw rows as a dump directory with a header line per file, in order if a number of files is given."""
    path = scratch_dir(raw.sparkSession)
    if n_files:
        raw = raw.repartitionByRange(n_files, "row").sortWithinPartitions("row")
    writer = raw.select(*columns).write.options(sep="\t", header=True, escape='"', compression=compression)
    writer.csv(path)
    return path


def _supplier_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as more main rows."""
    given = {"id": F.col("s_suppkey"), "name": F.col("s_name"), "ascii_name": F.upper("s_name")}
    suppliers = star.table(spark, sf_dir, "supplier")
    return suppliers.select(
        *[given.get(c, F.lit("")).cast("string").alias(c) for c in MAIN_COLUMNS],
        F.lit(0).alias("file_no"),
        F.lit(0).cast("long").alias("block"),
        F.col("s_suppkey").alias("row"),
    )


# --- files ----------------------------------------------------------------------------------------


def _scan_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _dump(star.raw_places(spark, sf_dir), MAIN_COLUMNS)
    return scan_places(spark, path).select(
        "id",
        "name",
        "ascii_name",
        "latitude",
        F.col("longitude").cast("double").alias("longitude"),
        "feature_class",
        "feature_code",
        "country_code",
        "elevation",
    )


def _scan_alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _dump(star.raw_alternates(spark, sf_dir), ALTERNATE_COLUMNS)
    return scan_alternates(spark, path).select(
        "id",
        "lang",
        "name",
        "preferred",
        "short",
        "colloquial",
        "historic",
        F.col("from").alias("valid_from"),
        F.col("to").alias("valid_to"),
    )


def _multi_path_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [
        _dump(star.raw_places(spark, sf_dir), MAIN_COLUMNS),
        _dump(_supplier_places(spark, sf_dir), MAIN_COLUMNS),
    ]
    return scan_places(spark, paths).select("id", "name", "ascii_name")


def _files_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that come from the order of rows in several files."""
    path = _dump(star.raw_places(spark, sf_dir), MAIN_COLUMNS, n_files=5)
    terms = Gazetteer.build(spark, path).terms
    return posting_lists(terms).select("term", "position", "type", "id")


def _compressed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [
        _dump(star.raw_places(spark, sf_dir), MAIN_COLUMNS, "gzip"),
        _dump(_supplier_places(spark, sf_dir), MAIN_COLUMNS, "bzip2"),
    ]
    return scan_places(spark, paths).select("id", "name", "ascii_name")


def _union_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _dump(star.raw_places(spark, sf_dir), MAIN_COLUMNS)
    pairs = main_pairs(scan_places(spark, [path, path]))
    return pairs.groupBy("term", "type", "id").agg(F.count("*").alias("n_pairs"))


# --- preparation ----------------------------------------------------------------------------------


def _odd_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are numbers in several spellings, or none."""
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 8
    text = (
        F.when(kind == 0, F.col("p_retailprice").cast("string"))
        .when(kind == 1, F.concat(F.lit(" "), size, F.lit(" ")))
        .when(kind == 2, F.col("p_type"))
        .when(kind == 3, F.concat(size, F.lit("f")))
        .when(kind == 4, F.concat(size, F.lit("e2")))
        .when(kind == 5, F.concat(F.lit("+"), size))
        .when(kind == 6, (F.col("p_partkey") * 40).cast("string"))
        .otherwise("")
    )
    return star.table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


def _lenient_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = _odd_numbers(spark, sf_dir).withColumn("parsed", lenient_float(F.col("text")))
    value = F.when(~F.isnan("parsed"), F.col("parsed").cast("double"))
    return numbers.select("p_partkey", F.isnan("parsed").alias("is_nan"), value.alias("value"))


def _lenient_smallint(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = lenient_smallint(F.col("text")).cast("int")
    return _odd_numbers(spark, sf_dir).select("p_partkey", parsed.alias("value"))


def _classify_alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [flag(F.col(name)) for name in ("preferred", "short", "colloquial", "historic")]
    return star.raw_alternates(spark, sf_dir).select("name", alternate_type(*flags).alias("type"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_pairs(star.raw_places(spark, sf_dir), star.raw_alternates(spark, sf_dir), None)


def _emit_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gazetteer(spark, sf_dir).terms.select(
        "term", "type", "id", "lang", F.col("from").alias("valid_from"), F.col("to").alias("valid_to"), "term_len"
    )


def _type_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).groupBy("type", F.col("ord").cast("int").alias("ord")).agg(F.count("*").alias("n_pairs"))


def _language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = place_records(star.raw_places(spark, sf_dir))
    pairs = alternate_pairs(star.raw_alternates(spark, sf_dir), places, LANGUAGES)
    return pairs.select("term", "type", "id", "lang")


def _alternates_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = place_records(star.raw_places(spark, sf_dir))
    return alternate_pairs(star.raw_alternates(spark, sf_dir), places).select("term", "type", "id")


def _places_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = place_records(star.raw_places(spark, sf_dir, rows_per_id=4))
    return places.select(
        "id",
        "name",
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
        "feature_class",
        "feature_code",
        "country_code",
        F.col("elevation").cast("int").alias("elevation"),
    )


def _posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists(_gazetteer(spark, sf_dir).terms).select("term", "position", "type", "id", "lang")


def _mention_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions through JSON lines, every other reference as a string."""
    number, text = F.col("reference"), F.col("text")
    as_text = F.to_json(F.struct(number.cast("string").alias("reference"), text))
    as_number = F.to_json(F.struct(number, text))
    path = scratch_dir(spark)
    lines = star.order_mentions(spark, sf_dir).select(F.when(number % 2 == 0, as_text).otherwise(as_number))
    lines.write.text(path)
    return read_mentions(spark, path)


# --- lookups over words of documents --------------------------------------------------------------


def _word_gazetteer(spark: SparkSession, sf_dir: str) -> Gazetteer:
    return Gazetteer.from_raw(star.raw_words(spark, sf_dir))


def _word_search(function, *arguments, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        results = function(_word_gazetteer(spark, sf_dir), *arguments, rank=True, **options)
        return results.select(
            F.col("key.name").alias("name"),
            F.col("key.type").alias("type"),
            F.col("key.id").alias("id"),
            F.col("entry.country_code").alias("country_code"),
            *[name for name in ("distance", "rank") if name in results.columns],
        )

    return query


def _tag_words(mode: str, selection: str, **options):
    """Words of conversations looked up among the words of documents."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tagged = tag(star.turn_words(spark, sf_dir), _word_gazetteer(spark, sf_dir), mode, selection, **options)
        return tagged.select("reference", F.col("key.name").alias("name"), F.col("key.type").alias("type"), F.col("key.id").alias("id"), "distance")

    return query


# --- other ----------------------------------------------------------------------------------------


def _distance_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = edit_distance(F.lit(NAME), star.part_name())
    return star.table(spark, sf_dir, "part").select("p_partkey", distance.alias("distance"))


def _stream_tag(mode: str):
    """Events as a stream of mentions, tagged until the table is used up, and read back.

    The glob is there because a file stream does not take the path of a single file.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema = star.table(spark, sf_dir, "events").schema
        events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
        mentions = star.event_mentions(events, star.table(spark, sf_dir, "part"))
        path, checkpoint = scratch_dir(spark), scratch_dir(spark)
        tag_stream(mentions, _saved(spark, sf_dir), path, checkpoint, mode=mode).awaitTermination()
        return _flat(spark.read.parquet(path))

    return query


def _catalogue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_stats(_gazetteer(spark, sf_dir))


def _load_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_counters(_pairs(spark, sf_dir))


def _provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance(spark, DATA_DATE, star.raw_alternates(spark, sf_dir)).select("user", "comment")


def _result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(tag(star.order_mentions(spark, sf_dir), _gazetteer(spark, sf_dir)))


def _response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and their provenance, written as one and read again."""
    path = scratch_dir(spark)
    made_by = provenance(spark, DATA_DATE, star.raw_alternates(spark, sf_dir))
    write_response(tag(star.order_mentions(spark, sf_dir), _gazetteer(spark, sf_dir)), made_by, path)
    response = read_response(spark, path)
    comment = response.provenance.select("comment").scalar()
    return _flat(response.results).select("reference", "name", "id", comment.alias("comment"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator or query; each callable takes (spark, sf_dir)."""
    small = {"feature_class": "E", "feature_code": "ECONOMY", "country_code": "Brand#2"}
    return {
        "scan_places": _scan_places,
        "scan_alternates": _scan_alternates,
        "multi_path_scan": _multi_path_scan,
        "compressed_scan": _compressed_scan,
        "union_files": _union_files,
        "lenient_float": _lenient_float,
        "lenient_smallint": _lenient_smallint,
        "classify_alternates": _classify_alternates,
        "emit_terms": _emit_terms,
        "type_ordinal": _type_ordinal,
        "language_filter": _language_filter,
        "alternates_semi": _alternates_semi,
        "places_last_wins": _places_last_wins,
        "posting_lists": _posting_lists,
        "mention_source": _mention_source,
        "files_posting_lists": _files_posting_lists,
        "find": _search(find, NAME),
        "find_in_order": _search(find, NAME, rank=False),
        "starts_with": _search(starts_with, "small ring"),
        "starts_with_capped": _search(starts_with, "small ring ECONOMY Brand#", 1),
        "fuzzy": _search(fuzzy, "smrngB#2"),
        "fuzzy_capped": _search(fuzzy, "smallringECONOMYBrand#2", 4),
        "levenshtein": _search(levenshtein, "smxll ring ECONOMY Brand#2", 2),
        "regex": _search(regex, "^small r(ing|od) [EP].*#1[0-9]?"),
        "distance_column": _distance_column,
        "filter_class": _search(starts_with, "small", feature_class="E"),
        "filter_code": _search(starts_with, "small", feature_code="ECONOMY"),
        "filter_country": _search(starts_with, "small", country_code="Brand#2"),
        "filter_conjunction": _search(starts_with, "small", **small),
        "find_word": _word_search(find, "la"),
        "starts_with_word": _word_search(starts_with, "él", 4),
        "fuzzy_word": _word_search(fuzzy, "ét"),
        "levenshtein_word": _word_search(levenshtein, "the", 1),
        "regex_word": _word_search(regex, WORD_PATTERN),
        "tag_find_all": _tag("find", "all"),
        "tag_find_first": _tag("find", "first"),
        "tag_starts_with_all": _tag("starts_with", "all"),
        "tag_starts_with_first": _tag("starts_with", "first"),
        "tag_starts_with_capped_all": _tag("starts_with", "all", max_dist=1),
        "tag_fuzzy_all": _tag("fuzzy", "all"),
        "tag_fuzzy_first": _tag("fuzzy", "first"),
        "tag_fuzzy_capped_all": _tag("fuzzy", "all", max_dist=2),
        "tag_levenshtein_all": _tag("levenshtein", "all"),
        "tag_levenshtein_first": _tag("levenshtein", "first"),
        "tag_levenshtein_two_first": _tag("levenshtein", "first", max_dist=2),
        "tag_filtered_first": _tag("levenshtein", "first", feature_class="E"),
        "tag_ranked": _tag("levenshtein", "all", rank=True),
        "tag_words_find_first": _tag_words("find", "first"),
        "tag_words_starts_with_first": _tag_words("starts_with", "first"),
        "tag_words_levenshtein_first": _tag_words("levenshtein", "first"),
        "tag_words_fuzzy_first": _tag_words("fuzzy", "first"),
        "saved_find": _search(find, NAME, gazetteer=_saved),
        "saved_starts_with": _search(starts_with, "small ring", gazetteer=_saved),
        "saved_regex": _search(regex, "^small r(ing|od) [EP].*#1[0-9]?", gazetteer=_saved),
        "saved_tag_find_first": _tag("find", "first", gazetteer=_saved),
        "saved_tag_levenshtein_first": _tag("levenshtein", "first", gazetteer=_saved),
        "saved_tag_levenshtein_all": _tag("levenshtein", "all", gazetteer=_saved),
        "saved_tag_starts_with_first": _tag("starts_with", "first", gazetteer=_saved),
        "saved_tag_fuzzy_first": _tag("fuzzy", "first", gazetteer=_saved),
        "stream_tag_find": _stream_tag("find"),
        "stream_tag_starts_with": _stream_tag("starts_with"),
        "stream_tag_levenshtein": _stream_tag("levenshtein"),
        "catalogue_stats": _catalogue_stats,
        "load_counters": _load_counters,
        "provenance": _provenance,
        "result_json": _result_json,
        "response": _response,
        **(llm.queries() if llm else {}),
        **({"pipeline": corpus_pipeline.run} if corpus_pipeline else {}),
    }


def oracle_sql() -> dict[str, str]:
    """The same queries as SQL on the same tables."""
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline and corpus_pipeline.ORACLE_SQL else {}
    return {**ORACLES, **(llm.oracle_sql() if llm else {}), **pipeline}
