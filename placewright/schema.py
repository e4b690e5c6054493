"""Column layouts shared by the whole package."""

from __future__ import annotations

# Column order of the two dump formats.
MAIN_COLUMNS = [
    "id",
    "name",
    "ascii_name",
    "alternate_names",
    "latitude",
    "longitude",
    "feature_class",
    "feature_code",
    "country_code",
    "cc2",
    "adm1",
    "adm2",
    "adm3",
    "adm4",
    "population",
    "elevation",
    "dem",
    "timezone",
    "modified",
]
ALTERNATE_COLUMNS = [
    "row_id",
    "id",
    "lang",
    "name",
    "preferred",
    "short",
    "colloquial",
    "historic",
    "from",
    "to",
]

# Columns that a file has to have.
REQUIRED_COLUMNS = ["id", "name", "ascii_name", "lang", "preferred", "short", "colloquial", "historic"]

# What a column holds when a file is too narrow to have it. Others are not read at all.
MAIN_DEFAULTS = {
    "latitude": "",
    "longitude": "",
    "feature_class": "<missing>",
    "feature_code": "<missing>",
    "country_code": "<missing>",
    "adm1": "",
    "adm2": "",
    "adm3": "",
    "adm4": "",
    "elevation": "",
}
ALTERNATE_DEFAULTS = {"from": "", "to": ""}

# Match types in rank order.
MATCH_TYPES = [
    "Name",
    "AsciiName",
    "PreferredName",
    "ShortName",
    "Colloquial",
    "Historic",
    "Alternate",
]

# Languages kept by default; the first one is the empty language.
DEFAULT_LANGUAGES = ["", "de", "deu", "ger", "de-DE", "de-AT", "de-CH"]

# Fixed value: label of the data date in provenance comments.
DATE_LABEL = "GeoNames Date: "

PLACE_FIELDS = [
    "id",
    "name",
    "latitude",
    "longitude",
    "feature_class",
    "feature_code",
    "country_code",
    "adm1",
    "adm2",
    "adm3",
    "adm4",
    "elevation",
]
KEY_FIELDS = ["name", "type", "id", "lang", "from", "to"]

# Position of a row in the input. `seq` orders search pairs the way they were read: main files before
# alternate files, files in the order given, rows in file order, ASCII name before main name.
POSITION_FIELDS = ["file_no", "block", "row"]
SEQ_FIELDS = ["src", "file_no", "block", "row", "slot"]
SRC_MAIN, SRC_ALTERNATE = 0, 1
