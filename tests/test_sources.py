"""Dump scans, mention sources, parsing."""

import bz2
import gzip
import json
import lzma
import math
import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from placewright import Gazetteer, find
from placewright.functions.parsing import lenient_float, lenient_smallint, strict_id
from placewright.schema import MAIN_COLUMNS
from placewright.sources import dumps
from placewright.sources.dumps import list_files, scan_alternates, scan_places
from placewright.sources.mentions import as_mentions, read_mentions
from placewright.sources.results import as_json, write_results
from tests.fixtures import alternate_lines, main_line, main_lines, write_dumps, write_lines


def names(scan):
    rows = scan.orderBy("file_no", "block", "row").collect()
    return [(r.file_no, r.name) for r in rows]


EXPECTED = ["Frankfurt", "Großer Feldberg", "Frankfort", "Frankfurt", "Feldberg"]


def test_header_is_dropped_per_file(spark, tmp_path):
    write_dumps(tmp_path)
    path = str(tmp_path / "places.txt")
    # Given twice, read twice, in the order given.
    assert names(scan_places(spark, [path, path])) == [(i, n) for i in (0, 1) for n in EXPECTED]
    assert names(scan_places(spark, path, header=False)) == [(0, n) for n in ["Lost", *EXPECTED]]


def test_directory(spark, tmp_path):
    folder = tmp_path / "a folder+"
    (folder / "below").mkdir(parents=True)
    write_lines(folder / "b.txt", main_lines())
    write_lines(folder / "a", main_lines()[:3])
    write_lines(folder / "below" / "c.txt", main_lines())
    extra = write_lines(tmp_path / "z.txt", main_lines()[3:])
    assert [f.rsplit("/", 1)[1] for f in list_files(spark, [str(folder), extra])] == ["a", "b.txt", "z.txt"]
    expected = [(0, n) for n in EXPECTED[:2]] + [(1, n) for n in EXPECTED] + [(2, n) for n in EXPECTED[3:]]
    assert names(scan_places(spark, [str(folder), extra])) == expected


@pytest.mark.parametrize("extension", ["gz", "bz2", "xz", "txt", "dump"])
def test_compression(spark, tmp_path, extension):
    opener = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}.get(extension, open)
    path = tmp_path / f"places.{extension}"
    with opener(path, "wt", encoding="utf-8") as out:
        out.write("\n".join(main_lines()) + "\n\n")
    scan = scan_places(spark, str(path))
    assert names(scan) == [(0, n) for n in EXPECTED]
    assert scan.filter("name = 'Frankfort'").first().elevation == ""


def test_xz_files_read_in_splits(spark, tmp_path):
    rng = random.Random(8)
    texts = {}
    for name in ("a b+c", "ü", "empty"):
        texts[name] = ["\t".join(str(rng.getrandbits(60)) for _ in range(3)) for _ in range(0 if name == "empty" else 3_000)]
        with lzma.open(tmp_path / f"{name}.xz", "wt", encoding="utf-8") as out:
            out.write("\n\r\n".join(texts[name]))
    assert (tmp_path / "ü.xz").read_bytes().count(b"\n") > 100
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = dumps._xz_lines(spark, [str(tmp_path)])
        rows = lines.collect()
        firsts = dumps._xz_lines(spark, [str(tmp_path)], heads=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "binaryFile" not in lines._jdf.queryExecution().toString()
    of = {unquote(r.file).rsplit("/", 1)[1][:-3] for r in rows}
    assert of == {"a b+c", "ü"}
    for name in of:
        assert [r.line for r in sorted((r for r in rows if unquote(r.file).endswith(f"/{name}.xz")), key=lambda r: r.row)] == texts[name]
    assert {(unquote(r.file).rsplit("/", 1)[1][:-3], r.row, r.line) for r in firsts} == {(name, 0, texts[name][0]) for name in of}


def test_xz_files_cut_short_fail(spark, tmp_path):
    whole = lzma.compress("\n".join(main_lines() * 500).encode())
    (tmp_path / "places.xz").write_bytes(whole[: len(whole) - 20])
    with pytest.raises(Exception, match="(?i)end-of-stream"):
        scan_places(spark, str(tmp_path / "places.xz")).select("name").collect()


def test_unknown_extension_warns(spark, tmp_path):
    with pytest.warns(UserWarning, match="unknown extension"):
        scan_places(spark, write_lines(tmp_path / "places.dump", main_lines()))


def test_archives_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="unpack"):
        scan_places(spark, write_lines(tmp_path / "places.zip", main_lines()))


def test_many_blocks_keep_file_order(spark, tmp_path):
    lines = [main_line((str(i), f"n{i:06d}", f"n{i:06d}", "1", "2", "P", "PPL", "DE", "1")) for i in range(20_000)]
    path = write_lines(tmp_path / "places.txt", lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        scan = scan_places(spark, path)
        assert scan.select("block").distinct().count() > 3
        shuffled = scan.repartition(7, "name").orderBy("file_no", "block", "row").select("id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [int(r.id) for r in shuffled] == list(range(1, 20_000))


def test_narrow_files_take_defaults(spark, tmp_path):
    narrow = [line.rsplit("\t", len(MAIN_COLUMNS) - 6)[0] for line in main_lines()]
    wide = [f"{line}\tmore" for line in main_lines()]
    paths = [
        write_lines(tmp_path / "narrow.txt", narrow),
        write_lines(tmp_path / "wide.txt", wide),
    ]
    scan = scan_places(spark, paths)
    assert names(scan) == [(i, n) for i in (0, 1) for n in EXPECTED]
    first = scan.filter("file_no = 0 and id = 101").first()
    assert (first.latitude, first.feature_class, first.country_code, first.adm1) == ("50.5", "<missing>", "<missing>", "")
    no_flags = [line.rsplit("\t", 2)[0] for line in alternate_lines()]
    alternates = scan_alternates(spark, write_lines(tmp_path / "alternates.txt", no_flags))
    assert {(r["from"], r["to"]) for r in alternates.collect()} == {("", "")}


@pytest.mark.parametrize("width", range(1, 8))
def test_files_without_required_columns_fail(spark, tmp_path, width):
    narrow = ["\t".join(line.split("\t")[:width]) for line in alternate_lines()]
    path = write_lines(tmp_path / "alternates.txt", narrow)
    with pytest.raises(ValueError, match="at least 8"):
        scan_alternates(spark, path)
    if width < 3:
        with pytest.raises(ValueError, match="at least 3"):
            scan_places(spark, path)


def test_empty_files_have_no_rows(spark, tmp_path):
    empty = write_lines(tmp_path / "empty.txt", [])
    assert scan_places(spark, empty).count() == 0
    both = scan_places(spark, [empty, write_lines(tmp_path / "places.txt", main_lines())])
    assert [n for _, n in names(both)] == EXPECTED


def test_directories_are_one_level(spark, tmp_path):
    (tmp_path / "d" / "k=1").mkdir(parents=True)
    (tmp_path / "d" / "more").mkdir()
    write_lines(tmp_path / "d" / "k=1" / "a.txt", main_lines())
    write_lines(tmp_path / "d" / "more" / "b.txt", main_lines())
    write_lines(tmp_path / "d" / "c.txt", main_lines())
    assert [n for _, n in names(scan_places(spark, str(tmp_path / "d")))] == EXPECTED
    for name in ("_hidden.txt", ".hidden.txt"):
        path = write_lines(tmp_path / name, main_lines())
        with pytest.raises(ValueError, match="underscore or a dot"):
            scan_places(spark, path)
    with pytest.raises(FileNotFoundError):
        scan_places(spark, str(tmp_path / "nothing"))


def test_multi_line_is_refused_for_xz(spark, tmp_path):
    path = tmp_path / "places.xz"
    with lzma.open(path, "wt", encoding="utf-8") as out:
        out.write("\n".join([*main_lines(), ""]))
    with pytest.raises(ValueError, match="multi_line"):
        scan_places(spark, str(path), multi_line=True)


def test_widths_take_jobs_by_reader_not_by_file(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for i in range(30):
        write_lines(tmp_path / "many" / f"p{i:02d}.txt", main_lines())
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("widths", "")
    try:
        scan = scan_places(spark, str(tmp_path / "many"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("widths")) < 8
    assert scan.count() == 30 * len(EXPECTED)


def test_coordinates_that_are_no_numbers(spark):
    schema = "key struct<name: string>, entry struct<id: long, name: string, latitude: float, longitude: float, feature_class: string, feature_code: string, country_code: string, adm1: string, adm2: string, adm3: string, adm4: string, elevation: short>"
    numbers = [math.inf, -math.inf, math.nan, 1.5]
    rows = [(("n",), (1, "n", x, 2.0, *[""] * 7, None)) for x in numbers]
    found = [json.loads(r.json)["entry"]["latitude"] for r in as_json(spark.createDataFrame(rows, schema)).collect()]
    assert found == [None, None, None, 1.5]


@pytest.mark.parametrize("reference", ["-5", "4294967296", "x", None])
def test_references_are_unsigned_32_bit(spark, reference):
    good = as_mentions(spark.createDataFrame([("4294967295", "t")], "reference string, text string")).first()
    assert good.reference == 4294967295
    with pytest.raises(Exception, match="not a reference number"):
        as_mentions(spark.createDataFrame([(reference, "t")], "reference string, text string")).collect()


@pytest.mark.parametrize("bad", ["105\tshort row", main_line(("106", "x", "x", *[""] * 6)) + "\textra"])
@pytest.mark.parametrize("extension", ["txt", "xz"])
def test_unequal_rows_fail(spark, tmp_path, bad, extension):
    path = tmp_path / f"places.{extension}"
    with {"txt": open, "xz": lzma.open}[extension](path, "wt", encoding="utf-8") as out:
        out.write("\n".join([*main_lines(), bad, ""]))
    with pytest.raises(Exception, match="(?i)malformed"):
        scan_places(spark, str(path)).select("name").collect()


def test_bad_ids(spark, tmp_path):
    bad_main = [*main_lines(), main_line((" 7", "x", "x", *[""] * 6))]
    main = scan_places(spark, write_lines(tmp_path / "bad.txt", bad_main))
    with pytest.raises(Exception, match="not a place id"):
        Gazetteer.from_raw(main).places.collect()
    good = scan_places(spark, write_lines(tmp_path / "places.txt", main_lines()))
    lines = [*alternate_lines(), "9\tnone\tfr\tName\t\t\t\t\t\t"]
    alternates = scan_alternates(spark, write_lines(tmp_path / "alternates.txt", lines))
    # Only a wanted language makes the id matter.
    assert Gazetteer.from_raw(good, alternates, ["de"]).terms.count() == 10
    with pytest.raises(Exception, match="not a place id"):
        Gazetteer.from_raw(good, alternates, ["de", "fr"]).terms.collect()


def test_quotes(spark, tmp_path):
    line = main_line(("105", '"a ""b""\tc"', "plain", *[""] * 6))
    path = write_lines(tmp_path / "places.txt", [*main_lines(), line])
    assert names(scan_places(spark, path))[-1] == (0, 'a "b"\tc')
    raw = write_lines(tmp_path / "raw.txt", [*main_lines(), main_line(("105", '"Al" fine', "x", *[""] * 6))])
    assert names(scan_places(spark, raw, quote=""))[-1] == (0, '"Al" fine')


def test_empty_names_are_no_terms(spark, tmp_path):
    line = main_line(("105", "", "ascii", *[""] * 6))
    gazetteer = Gazetteer.build(spark, write_lines(tmp_path / "places.txt", [*main_lines(), line]))
    assert [r.type for r in gazetteer.terms.filter("id = 105").collect()] == ["AsciiName"]
    assert find(gazetteer, "ascii").first().entry.name == ""


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_lenient_float(spark):
    good = {" 1.5 ": 1.5, " -2\n": -2.0, "+.5": 0.5, "3.": 3.0, "1e2": 100.0, "-1E-1": -0.1, "1e99": math.inf}
    good |= {"inf": math.inf, "-Infinity": -math.inf, "16777217": 16777216.0}
    assert column(spark, good, lenient_float) == pytest.approx(list(good.values()))
    bad = ["", "x", "1.5f", "2d", "0x10", "1 2", "nan", "-nan", "1_0", "e5", ".", None]
    assert all(math.isnan(v) for v in column(spark, bad, lenient_float))


def test_lenient_smallint(spark):
    texts = ["12", "+7", "-32768", "32767", "32768", " 12 ", "12.7", "", "x", "1\n", None]
    assert column(spark, texts, lenient_smallint) == [12, 7, -32768, 32767, *[None] * 7]


def test_strict_id(spark):
    assert column(spark, ["5", "+5", "0012"], strict_id) == [5, 5, 12]
    for bad in ("", "-5", " 5", "5.0", "9223372036854775808", None):
        with pytest.raises(Exception, match="not a place id"):
            column(spark, [bad], strict_id)


def test_mentions(spark, tmp_path):
    path = tmp_path / "mentions.json"
    path.write_text('{"reference": 1, "text": "a"}\n{"reference": "2", "text": "ä"}\n', encoding="utf-8")
    assert [tuple(r) for r in read_mentions(spark, str(path)).orderBy("reference").collect()] == [(1, "a"), (2, "ä")]
    with pytest.raises(Exception, match="not a reference number"):
        as_mentions(spark.createDataFrame([("x", "a")], "reference string, text string")).collect()


def test_json(spark, gazetteer, tmp_path):
    records = [json.loads(r.json) for r in as_json(find(gazetteer, "Frankfurt")).collect()]
    assert [r["key"] for r in records] == [
        {"name": "Frankfurt", "type": "Name", "id": 101},
        {"name": "Frankfurt", "type": "Name", "id": 104},
    ]
    assert list(records[0]) == ["key", "entry"]
    assert records[0]["entry"]["elevation"] == 112
    # Unknown coordinates are null, an unknown elevation is absent.
    assert records[1]["entry"]["latitude"] is None
    assert "elevation" not in records[1]["entry"]
    write_results(find(gazetteer, "Franconofurd"), str(tmp_path / "out"), "json")
    (record,) = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert record["key"] == {
        "name": "Franconofurd",
        "type": "Historic",
        "id": 101,
        "lang": "de",
        "from": "794",
        "to": "1200",
    }
    write_results(find(gazetteer, "FFM"), str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).first().key.lang == ""
