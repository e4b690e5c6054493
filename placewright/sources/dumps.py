"""Scans of delimited place dumps.

Every scan returns the dump's columns as strings plus the position of each row in the input
(``file_no``, ``block``, ``row``), because later steps depend on the order of the input and a
distributed scan has none.
"""

from __future__ import annotations

import csv
import io
import itertools
import lzma
import re
import warnings
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.schema import (
    ALTERNATE_COLUMNS,
    ALTERNATE_DEFAULTS,
    MAIN_COLUMNS,
    MAIN_DEFAULTS,
    POSITION_FIELDS,
    REQUIRED_COLUMNS,
)

_LINES_PER_BATCH = 20_000
_XZ_BUFFER = 1 << 20


# A file's status as the file system prints it; a path may hold anything but the line break that separates them here.
_STATUS = re.compile(r"\w+\{path=(?P<path>.*?); isDirectory=false; length=(?P<length>\d+);")


def _files_below(spark: SparkSession, system, path) -> list[tuple[str, int]]:
    """Paths and lengths of a file, or of the files of a folder; one call to the JVM gives all, however many there are."""
    jvm = spark._jvm.org.apache.hadoop.util
    statuses = jvm.functional.RemoteIterators.toList(system.listFiles(path, False))
    printed = jvm.StringUtils.join("\n", statuses)
    found = [_STATUS.match(line) for line in printed.split("\n")] if printed else []
    return [(m["path"], int(m["length"])) for m in found]


def list_files(spark: SparkSession, paths: str | Iterable[str]) -> list[str]:
    """Expand files and directories (one level, sorted) into a list of files, in order.

    Folders within a directory are not looked at. Spark's readers take no files whose names begin with an
    underscore or a dot, so these are refused rather than left out, unless they are empty.
    """
    jvm, configuration = spark._jvm, spark._jsc.hadoopConfiguration()
    files: list[str] = []
    for path in [paths] if isinstance(paths, str) else paths:
        given = jvm.org.apache.hadoop.fs.Path(path)
        system = given.getFileSystem(configuration)
        if system.exists(given):
            members = _files_below(spark, system, given)
        else:
            found = system.globStatus(given)
            if not found:
                raise FileNotFoundError(path)
            members = [(status.getPath().toString(), status.getLen()) for status in found if status.isFile()]
        for file, length in sorted(members):
            if file.rsplit("/", 1)[-1][0] not in "_.":
                files.append(file)
            elif length:
                raise ValueError(f"{file}: names that begin with an underscore or a dot cannot be read")
    return files


def scan_places(spark: SparkSession, paths: str | Iterable[str], **options) -> DataFrame:
    """Scan main dump files; see :func:`scan_dump` for the options."""
    return scan_dump(spark, paths, MAIN_COLUMNS, MAIN_DEFAULTS, **options)


def scan_alternates(spark: SparkSession, paths: str | Iterable[str], **options) -> DataFrame:
    """Scan alternate-name dump files; see :func:`scan_dump` for the options."""
    return scan_dump(spark, paths, ALTERNATE_COLUMNS, ALTERNATE_DEFAULTS, **options)


def scan_dump(
    spark: SparkSession,
    paths: str | Iterable[str],
    columns: list[str],
    defaults: dict[str, str],
    *,
    header: bool = True,
    quote: str = '"',
    multi_line: bool = False,
    width: int | None = None,
) -> DataFrame:
    """Tab-separated files or directories of files as one bag of rows.

    The first record of *each* file is dropped unless ``header`` is off. All rows of a file must have
    the same number of columns; the number may differ between files and is read from the first lines of
    all files in one job unless ``width`` gives it. Columns that a file lacks take their default; a file
    that lacks one without a default is refused, even where no row would use it. ``txt``, extension-less, ``gz``, ``bz2`` and
    ``xz`` files are read; ``zip`` files are refused, and so is ``multi_line`` for ``xz``. A file that
    is given twice is read twice.
    """
    files = list_files(spark, paths)
    if not files:
        raise ValueError("no input files")
    options = {"sep": "\t", "quote": quote, "escape": '"' if quote else "", "mode": "FAILFAST"}
    # One scan per (reader, width), not per file, so that the plan does not grow with the input.
    groups: dict[tuple[bool, int], list[tuple[int, str]]] = defaultdict(list)
    is_xz_file = {file: _check_extension(file) == "xz" for file in dict.fromkeys(files)}
    if multi_line and any(is_xz_file.values()):
        raise ValueError("xz files are read line by line: multi_line is not supported for them")
    widths = dict.fromkeys(files, width) if width else _widths(spark, is_xz_file, options)
    required = max(i for i, name in enumerate(columns) if name not in defaults and name in REQUIRED_COLUMNS) + 1
    for file_no, file in enumerate(files):
        n_columns = widths.get(file)
        if n_columns is None:  # an empty file
            continue
        if n_columns < required:
            raise ValueError(f"{file}: {n_columns} columns, at least {required} are needed")
        groups[is_xz_file[file], n_columns].append((file_no, file))
    if not groups:
        names = ", ".join(f"`{name}` string" for name in columns)
        return spark.createDataFrame([], f"{names}, file_no int, block long, row long")
    scans = []
    for (is_xz, n_columns), numbered in groups.items():
        names = [*columns, *(f"_extra{i}" for i in range(n_columns))][:n_columns]
        ddl = ", ".join(f"`{name}` string" for name in names)
        if is_xz:
            scan = _scan_xz(spark, _distinct(numbered), ddl, options, header)
        else:
            reader = spark.read.schema(ddl).options(**options, header=header, multiLine=multi_line)
            # Without pruning, rows of a wrong width fail even if a query needs few columns.
            scan = reader.option("columnPruning", False).csv(_distinct(numbered))
            scan = scan.select(
                *names,
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            )
        file_table = spark.createDataFrame(
            [(no, _join_form(file)) for no, file in numbered], "file_no int, file string"
        )
        # a local table, whose size Spark knows: it is broadcast if it is small
        scan = scan.withColumn("file", _join_form_column(F.col("file")))
        scan = scan.join(file_table, "file")
        scans.append(scan.select(*_complete(columns, defaults, names), *POSITION_FIELDS))
    result = scans[0]
    for scan in scans[1:]:
        result = result.unionByName(scan)
    return result


def _complete(columns: list[str], defaults: dict[str, str], present: list[str]) -> list[Column]:
    """All dump columns: empty fields as empty strings, absent ones as their default or null."""
    return [
        F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(name)
        if name in present
        else F.lit(defaults.get(name)).cast("string").alias(name)
        for name in columns
    ]


def _check_extension(file: str) -> str:
    name = file.rsplit("/", 1)[-1].lstrip(".")
    extension = name.rsplit(".", 1)[1] if "." in name else "txt"
    if extension == "zip":
        raise ValueError(f"{file}: unpack the archive and pass the files that it holds")
    if extension not in ("txt", "gz", "bz2", "xz"):
        warnings.warn(f"{file}: unknown extension, reading it as plain text", stacklevel=4)
    return extension


def _distinct(numbered: list[tuple[int, str]]) -> list[str]:
    return list(dict.fromkeys(file for _, file in numbered))


def _join_form(file: str) -> str:
    return re.sub(r"^file:/+", "file:/", file)


def _join_form_column(file: Column) -> Column:
    # url_decode would also turn a plus sign into a space
    file = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(file, "^file:/+", "file:/")


def _widths(spark: SparkSession, is_xz_file: dict[str, bool], options: dict) -> dict[str, int]:
    """Number of columns in the first record of each file that has one; one job per reader, whatever the number of files.

    A line per file comes to the driver, which holds the names of the files anyway.
    """
    quote = options["quote"]
    quoting = {"quotechar": quote} if quote else {"quoting": csv.QUOTE_NONE}
    heads: dict[str, str] = {}
    for is_xz in (False, True):
        files = [file for file, xz in is_xz_file.items() if xz == is_xz]
        if not files:
            continue
        if is_xz:
            lines = _xz_lines(spark, files, heads=True).select("file", F.col("row").alias("at"), F.col("line").alias("value"))
        else:
            lines = spark.read.text(files).where("_metadata.file_block_start = 0 and value <> ''")
            lines = lines.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
        first = lines.groupBy("file").agg(F.min_by("value", "at").alias("value"))
        found = {unquote(r.file): r.value for r in first.toLocalIterator()}
        found = {_join_form(file): value for file, value in found.items()}
        heads.update({file: found[_join_form(file)] for file in files if _join_form(file) in found})
    widths = {}
    for file, line in heads.items():
        if quote and line.count(quote) % 2:  # the first record goes on in the next line
            widths[file] = len(spark.read.options(**options, multiLine=True).csv(file).columns)
        else:
            widths[file] = len(next(csv.reader([line], delimiter=options["sep"], **quoting)))
    return widths


def _scan_xz(
    spark: SparkSession, files: list[str], ddl: str, options: dict, header: bool
) -> DataFrame:
    """Rows of xz files, for which there is no splittable or built-in codec: one task per file."""
    lines = _xz_lines(spark, files).filter(F.col("line") != "")
    if header:
        lines = lines.filter("row > 0")
    parsed = lines.withColumn("parsed", F.from_csv("line", ddl, options))
    return parsed.select("parsed.*", "file", F.lit(0).cast("long").alias("block"), "row")


def _xz_lines(spark: SparkSession, files: list[str], heads: bool = False) -> DataFrame:
    """``file``, ``row`` and ``line`` of the lines that are not blank, or of the first one of each file.

    The bytes between two line feeds are the rows of a text scan, so that any file system reads a file in splits; put in
    order again they are decompressed as they come. A task holds a piece of a file at a time, however long it is.
    """
    raw = spark.read.text(files, lineSep="\n")
    if heads:
        raw = raw.where("_metadata.file_block_start = 0")
    raw = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").cast("binary").alias("piece"),
    )
    pieces = raw.repartition("file").sortWithinPartitions("file", "start", "at").select("file", "piece")
    return pieces.mapInArrow(_decompressing(heads), "file string, row long, line string")


class _Pieces(io.RawIOBase):
    """The bytes of a file from its pieces between line feeds."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces = itertools.chain.from_iterable((b"\n", piece) if i else (piece,) for i, piece in enumerate(pieces))
        self.rest = memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: memoryview) -> int:
        while not self.rest:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.rest = memoryview(piece)
        n = min(len(buffer), len(self.rest))
        buffer[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _decompressing(heads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def decompress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist(), strict=True))
        for file, pieces in itertools.groupby(rows, key=lambda row: row[0]):
            source = io.BufferedReader(_Pieces(piece for _, piece in pieces), _XZ_BUFFER)
            with lzma.open(source, "rt", encoding="utf-8") as stream:
                # Blank lines are no records; the first record counts as row 0.
                lines = (line.rstrip("\n") for line in stream)
                numbered = enumerate(line for line in lines if line)
                if heads:
                    numbered = itertools.islice(numbered, 1)
                while chunk := list(itertools.islice(numbered, _LINES_PER_BATCH)):
                    numbers, values = zip(*chunk, strict=True)
                    columns = [pa.array([file] * len(chunk)), pa.array(numbers, pa.int64()), pa.array(values, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "row", "line"])

    return decompress
