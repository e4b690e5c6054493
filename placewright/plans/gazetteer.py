"""The gazetteer: place records and searchable terms."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.functions.parsing import strict_id
from placewright.operators.joins import gram_counts
from placewright.operators.reduction import leaders
from placewright.operators.terms import alternate_pairs, last_rows, main_pairs, place_records, searchable
from placewright.plans.saved import PLACES, load_tables, save_tables
from placewright.schema import DEFAULT_LANGUAGES, SRC_ALTERNATE, SRC_MAIN
from placewright.sources.dumps import scan_alternates, scan_places


@dataclass
class Gazetteer:
    """``places`` has one row per id, ``terms`` one row per search pair; a saved one has ``tables`` for joins besides."""

    places: DataFrame
    terms: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict, repr=False)
    _known: dict = field(default_factory=dict, repr=False)

    @classmethod
    def from_raw(
        cls,
        main: DataFrame,
        alternates: DataFrame | None = None,
        languages: Sequence[str] | None = DEFAULT_LANGUAGES,
    ) -> Gazetteer:
        """From raw rows with a position, as the scans in ``sources.dumps`` return them."""
        places = place_records(main)
        return cls(places, searchable(search_pairs(main, alternates, languages)), _known={"main": main})

    @classmethod
    def build(
        cls,
        spark: SparkSession,
        paths: str | Iterable[str],
        alternates: str | Iterable[str] | None = None,
        languages: Sequence[str] | None = DEFAULT_LANGUAGES,
        all_languages: bool = False,
        **scan_options,
    ) -> Gazetteer:
        """From dump files or directories of them."""
        main = scan_places(spark, paths, **scan_options)
        raw = scan_alternates(spark, alternates, **scan_options) if alternates else None
        return cls.from_raw(main, raw, None if all_languages else languages)

    def save(
        self, path: str, mode: str = "errorifexists", *, distances: Sequence[int] = (1,), prefixes: bool = True
    ) -> Gazetteer:
        """Write all tables and return the gazetteer that reads them.

        Terms are range-partitioned and sorted, so that exact and prefix lookups skip files and row
        groups by their statistics. The insertion order is part of the sort key: it divides a name
        that many places share. Places, the best posting of every term and every prefix, and the deletion keys of terms for
        the given ``distances`` are bucketed for joins; see ``plans.saved``.
        """
        spark = self.terms.sparkSession
        terms = self.terms.repartitionByRange("term", "seq").sortWithinPartitions("term", "seq")
        terms.write.mode(mode).option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/terms")
        save_tables(self.places, spark.read.parquet(f"{path}/terms"), path, tuple(distances), prefixes)
        return self.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Gazetteer:
        """The gazetteer saved below ``path``, in the same or another session."""
        facts, tables = load_tables(spark, path)
        return cls(tables[PLACES], spark.read.parquet(f"{path}/terms"), tables, {"longest_term": facts["longest_term"]})

    def longest_term(self) -> int:
        """Length of the longest term; one aggregation, done once per gazetteer."""
        if "longest_term" not in self._known:
            row = self.vocabulary().agg(F.max(F.length("term")).alias("longest")).first()
            self._known["longest_term"] = row.longest or 0
        return self._known["longest_term"]

    def vocabulary(self) -> DataFrame:
        """The distinct terms, each with its least match type and id and its number of postings; written once per gazetteer."""
        if "vocabulary" not in self._known:
            self._known["vocabulary"] = leaders(self.terms, "term", ["ord", "id"])
        return self._known["vocabulary"]

    def entries(self) -> DataFrame:
        """The places, for consumers of whole records: rows that others overwrite go before they are aggregated."""
        if "entries" not in self._known:
            main = self._known.get("main")
            self._known["entries"] = self.places if main is None else place_records(last_rows(main))
        return self._known["entries"]

    def gram_counts(self) -> DataFrame:
        """Numbers of terms under pairs of bytes, for subsequence joins; counted once per gazetteer."""
        if "gram_counts" not in self._known:
            self._known["gram_counts"] = gram_counts(self.vocabulary().select("term"))
        return self._known["gram_counts"]


def search_pairs(
    main: DataFrame, alternates: DataFrame | None, languages: Sequence[str] | None
) -> DataFrame:
    """The bag of all search pairs of the raw rows, with those of empty terms."""
    pairs = main_pairs(main)
    if alternates is None:
        return pairs
    # The semi join asks for existence only, so it takes the ids as they come.
    place_ids = main.select(strict_id(F.col("id")).alias("id"))
    return pairs.unionByName(alternate_pairs(alternates, place_ids, languages))


def load_counters(pairs: DataFrame) -> DataFrame:
    """How many search pairs the main files gave, and how many all files."""
    from_main = F.count_if(F.col("seq.src") == SRC_MAIN)
    from_alternates = F.count_if(F.col("seq.src") == SRC_ALTERNATE)
    return pairs.agg(from_main.alias("main_pairs"), (from_main + from_alternates).alias("all_pairs"))
