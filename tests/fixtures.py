"""The small hand-made gazetteer of FIXTURES.md, section 3."""

from pathlib import Path

from placewright.schema import MAIN_COLUMNS

PLACES = [
    # id, name, ascii name, latitude, longitude, class, code, country, elevation
    ("100", "Lost", "Lost", "0", "0", "P", "PPL", "DE", "1"),
    ("101", "Frankfurt", "Frankfurt", "50.5", "8.5", "P", "PPL", "DE", "112"),
    ("102", "Großer Feldberg", "Grosser Feldberg", "50.25", "8.25", "T", "MT", "DE", "879"),
    ("103", "Frankfort", "Frankfort", "38.5", "-84.5", "P", "PPLA", "US", ""),
    ("104", "Frankfurt", "Frankfurt", "x", "1.5", "P", "PPL", "US", "40000"),
    ("102", "Feldberg", "Feldberg", "47.5", "8", "T", "MT", "DE", "1493"),
]
ALTERNATES = [
    # id, lang, name, preferred, short, colloquial, historic, from, to
    ("101", "de", "Swallowed", "1", "", "", "", "", ""),
    ("101", "de", "Frankfurt am Main", "1", "", "", "", "", ""),
    ("101", "", "FFM", "", "1", "", "", "", ""),
    ("101", "de", "Mainhattan", "", "", "1", "", "", ""),
    ("103", "fr", "Francfort", "", "", "", "", "", ""),
    ("102", "de", "Feldberg", "1", "1", "", "", "", ""),
    ("101", "de", "Franconofurd", "", "", "", "1", "794", "1200"),
    ("999", "de", "Nirgendwo", "1", "", "", "", "", ""),
]
TERMS = [
    ("Frankfurt", "Name", 101, None, None, None),
    ("Grosser Feldberg", "AsciiName", 102, None, None, None),
    ("Großer Feldberg", "Name", 102, None, None, None),
    ("Frankfort", "Name", 103, None, None, None),
    ("Frankfurt", "Name", 104, None, None, None),
    ("Feldberg", "Name", 102, None, None, None),
    ("Frankfurt am Main", "PreferredName", 101, "de", None, None),
    ("FFM", "ShortName", 101, "", None, None),
    ("Mainhattan", "Colloquial", 101, "de", None, None),
    ("Feldberg", "Alternate", 102, "de", None, None),
    ("Franconofurd", "Historic", 101, "de", "794", "1200"),
]


def main_line(row) -> str:
    place_id, name, ascii_name, lat, lon, feature_class, code, country, elevation = row
    given = {
        "id": place_id,
        "name": name,
        "ascii_name": ascii_name,
        "latitude": lat,
        "longitude": lon,
        "feature_class": feature_class,
        "feature_code": code,
        "country_code": country,
        "elevation": elevation,
    }
    return "\t".join(given.get(column, "") for column in MAIN_COLUMNS)


def alternate_line(number: int, row) -> str:
    return "\t".join([str(number), *row])


def main_lines() -> list[str]:
    return [main_line(row) for row in PLACES]


def alternate_lines() -> list[str]:
    return [alternate_line(i, row) for i, row in enumerate(ALTERNATES)]


def write_lines(path: Path, lines: list[str]) -> str:
    path.write_text("".join(f"{line}\n" for line in lines), encoding="utf-8")
    return str(path)


def write_dumps(folder: Path) -> Path:
    write_lines(folder / "places.txt", main_lines())
    write_lines(folder / "alternates.txt", alternate_lines())
    return folder
