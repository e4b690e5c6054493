"""SQL oracles for the registered queries, on the test tables."""

from __future__ import annotations

NAME = "small ring ECONOMY Brand#2"

_RAW = """
raw AS (
  SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_brand AS name,
         CAST(CAST(p_size AS FLOAT) AS DOUBLE) AS latitude,
         CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS longitude,
         substr(p_type, 1, 1) AS feature_class, p_type AS feature_code, p_brand AS country_code,
         CASE WHEN p_size % 5 <> 0 THEN p_size END AS elevation
  FROM part),
main AS (
  SELECT *, CASE WHEN id % 3 = 0 THEN replace(name, 'e', 'a') ELSE name END AS ascii_name FROM raw),
alt AS (
  SELECT c_custkey AS row_id, c_custkey * 2 AS id, lower(c_mktsegment) AS lang, c_name AS name,
         c_custkey % 2 = 0 AS p, c_custkey % 3 = 0 AS s, c_custkey % 5 = 0 AS c, c_custkey % 7 = 0 AS h,
         CAST(c_nationkey AS VARCHAR) AS vf, CAST(c_nationkey + 100 AS VARCHAR) AS vt
  FROM customer),
alt_typed AS (
  SELECT *, CASE WHEN CAST(p AS INT) + CAST(s AS INT) + CAST(c AS INT) + CAST(h AS INT) <> 1 THEN 'Alternate'
                 WHEN p THEN 'PreferredName' WHEN s THEN 'ShortName' WHEN c THEN 'Colloquial'
                 ELSE 'Historic' END AS type
  FROM alt),
pairs AS (
  SELECT ascii_name AS term, 'AsciiName' AS type, 1 AS ord, id, CAST(NULL AS VARCHAR) AS lang,
         CAST(NULL AS VARCHAR) AS valid_from, CAST(NULL AS VARCHAR) AS valid_to,
         0 AS src, id AS rowno, 0 AS slot
  FROM main WHERE ascii_name <> name
  UNION ALL
  SELECT name, 'Name', 0, id, NULL, NULL, NULL, 0, id, 1 FROM main
  UNION ALL
  SELECT name, type,
         CASE type WHEN 'PreferredName' THEN 2 WHEN 'ShortName' THEN 3 WHEN 'Colloquial' THEN 4
                   WHEN 'Historic' THEN 5 ELSE 6 END,
         id, lang, CASE WHEN type = 'Historic' THEN vf END, CASE WHEN type = 'Historic' THEN vt END,
         1, row_id, 0
  FROM alt_typed WHERE id IN (SELECT id FROM main)),
terms AS (SELECT * FROM pairs WHERE term <> '')
"""

_MENTIONS = """
named AS (
  SELECT o_orderkey AS reference, o_custkey, p_name || ' ' || p_type || ' ' || p_brand AS name
  FROM orders JOIN part ON o_custkey = p_partkey),
mentions AS (
  SELECT reference,
         CASE reference % 4 WHEN 0 THEN name WHEN 1 THEN substr(name, 1, length(name) - 2)
              WHEN 2 THEN substr(name, 1, 1) || substr(name, 3)
              ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS text
  FROM named)
"""

_EVENT_MENTIONS = """
mentions AS (
  SELECT event_id AS reference, p_name || ' ' || p_type || ' ' || p_brand AS text
  FROM events JOIN part ON user_id = p_partkey)
"""

_SUPPLIERS = "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, upper(s_name) AS ascii_name FROM supplier"

_RESULT = """t.term AS name, t.type, t.id, t.lang, t.valid_from, t.valid_to, m.name AS entry_name,
  m.latitude, m.longitude, m.feature_class, m.feature_code, m.country_code, m.elevation"""


def _search(condition: str, distance: str | None, order: str, places: str = "true") -> str:
    columns = f"{distance} AS distance, " if distance else ""
    return f"""WITH {_RAW}, hits AS (
  SELECT {columns}{_RESULT}, t.ord, t.src, t.rowno, t.slot
  FROM terms t JOIN main m ON t.id = m.id WHERE ({condition}) AND ({places}))
SELECT {"distance, " if distance else ""}row_number() OVER (ORDER BY {order}) AS "rank", name, type, id, lang,
  valid_from, valid_to, entry_name, latitude, longitude, feature_class, feature_code, country_code, elevation
FROM hits"""


_BY_DISTANCE = "distance, ord, id, name, src, rowno, slot"
_LENGTH_GAP = "CAST(length(t.term) - {} AS INTEGER)"
_SUBSEQUENCE = "term LIKE '%' || array_to_string(string_split(text, ''), '%') || '%'"


def _starts(query: str, places: str = "true", cap: int = 0) -> str:
    gap = _LENGTH_GAP.format(len(query))
    condition = f"starts_with(t.term, '{query}')" + (f" AND {gap} <= {cap}" if cap else "")
    return _search(condition, gap, _BY_DISTANCE, places)


def _tag(match: str, distance: str, selection: str, where: str = "true", ranked: bool = False) -> str:
    """`match` and `distance` are over a distinct `text` and a distinct `term`."""
    order = "src, rowno, slot" if match == "text = term" else "distance, t.ord, t.id, t.term, src, rowno, slot"
    return f"""WITH {_RAW}, {_MENTIONS},
texts AS (SELECT DISTINCT text FROM mentions),
dictionary AS (SELECT DISTINCT term FROM terms),
met AS (SELECT text, term, CAST({distance} AS INTEGER) AS distance
        FROM texts JOIN dictionary ON {match}),
hits AS (
  SELECT met.text, met.distance, {_RESULT},
         row_number() OVER (PARTITION BY met.text ORDER BY {order}) AS "rank"
  FROM met JOIN terms t ON met.term = t.term JOIN main m ON t.id = m.id WHERE {where})
SELECT reference, distance, name, type, id, lang, valid_from, valid_to, entry_name, latitude, longitude,
  feature_class, feature_code, country_code, elevation{', "rank"' if ranked else ""}
FROM mentions JOIN hits USING (text){' WHERE "rank" = 1' if selection == "first" else ""}"""


_EXACT = ("text = term", "0")
_PREFIX = ("starts_with(term, text)", "length(term) - length(text)")
_PREFIX_CAPPED = ("starts_with(term, text) AND length(term) - length(text) <= 1", "length(term) - length(text)")
_FUZZY = (f"length(term) >= length(text) AND {_SUBSEQUENCE}", "length(term) - length(text)")
_FUZZY_CAPPED = (
    f"length(term) - length(text) BETWEEN 0 AND 2 AND {_SUBSEQUENCE}",
    "length(term) - length(text)",
)


def _edits(k: int) -> tuple[str, str]:
    near = f"abs(length(term) - length(text)) <= {k} AND levenshtein(text, term) <= {k}"
    return near, "levenshtein(text, term)"


# Words of documents.
_WORDS = r"""
listed AS (
  SELECT doc_id, lang, unnest(regexp_split_to_array(text, '\s+')) AS name,
         generate_subscripts(regexp_split_to_array(text, '\s+'), 1) AS pos
  FROM documents),
plain AS (SELECT *, translate(name, 'éèêàçù', 'eeeacu') AS ascii_name FROM listed),
terms AS (
  SELECT * FROM (
    SELECT ascii_name AS term, 'AsciiName' AS type, 1 AS ord, doc_id AS id, lang, pos, 0 AS slot
    FROM plain WHERE ascii_name <> name
    UNION ALL
    SELECT name, 'Name', 0, doc_id, lang, pos, 1 FROM plain)
  WHERE term <> '')
"""


def _word_search(condition: str, distance: str | None, order: str) -> str:
    columns = f"{distance} AS distance, " if distance else ""
    return f"""WITH {_WORDS}, hits AS (SELECT {columns}* FROM terms WHERE {condition})
SELECT term AS name, type, id, lang AS country_code, {"distance, " if distance else ""}
  row_number() OVER (ORDER BY {order}) AS "rank"
FROM hits"""


def _one_byte(text: str) -> str:
    """Accented letters as control characters, one byte each, for a distance that counts bytes."""
    letters = "éèêàçùÉÈÊÀÇÙ"
    controls = " || ".join(f"chr({i})" for i in range(1, len(letters) + 1))
    return f"translate({text}, '{letters}', {controls})"


_WORD_ORDER = "ord, id, term, pos, slot"
_ONE_EDIT = ["the", "he", "te", "th", "_he", "t_e", "th_", "_the", "t_he", "th_e", "the_"]
_THE = " OR ".join(f"term LIKE '{pattern}'" for pattern in _ONE_EDIT)


def _tag_words(met: str, order: str) -> str:
    return rf"""WITH {_WORDS},
mentions AS (
  SELECT conv_id AS reference, unnest(regexp_split_to_array(text, '\s+')) AS text FROM conversations),
texts AS (SELECT DISTINCT text FROM mentions),
dictionary AS (SELECT DISTINCT term FROM terms),
met AS ({met}),
best AS (
  SELECT met.text, met.distance, term, type, id,
         row_number() OVER (PARTITION BY met.text ORDER BY {order}) AS "rank"
  FROM met JOIN terms USING (term))
SELECT reference, term AS name, type, id, distance FROM mentions JOIN best USING (text) WHERE "rank" = 1"""


# Texts and terms at most one edit apart, by what is left after deleting one character: equal strings,
# one string left by the other, or the same string left by both at the same place.
_ONE_EDIT_APART = """
  WITH short_texts AS (
    SELECT text, i, substr(text, 1, i - 1) || substr(text, i + 1) AS rest
    FROM (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM texts)),
  short_terms AS (
    SELECT term, i, substr(term, 1, i - 1) || substr(term, i + 1) AS rest
    FROM (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM dictionary)),
  near AS (
    SELECT text, term, 0 AS d FROM texts JOIN dictionary ON text = term
    UNION ALL SELECT text, term, 1 FROM short_texts JOIN dictionary ON rest = term
    UNION ALL SELECT text, term, 1 FROM texts JOIN short_terms ON text = rest
    UNION ALL SELECT text, term, 1 FROM short_texts JOIN short_terms USING (i, rest) WHERE text <> term)
  SELECT text, term, CAST(min(d) AS INTEGER) AS distance FROM near GROUP BY text, term"""

_FLAT_JSON = """'{"reference":' || reference || ',"key":{"name":"' || name || '","type":"' || type
  || '","id":' || id || coalesce(',"lang":"' || lang || '"', '') || coalesce(',"from":"' || valid_from || '"', '')
  || coalesce(',"to":"' || valid_to || '"', '') || '},"entry":{"id":' || id || ',"name":"' || entry_name
  || '","latitude":' || CAST(CAST(latitude AS FLOAT) AS VARCHAR)
  || ',"longitude":' || CAST(CAST(longitude AS FLOAT) AS VARCHAR)
  || ',"feature_class":"' || feature_class || '","feature_code":"' || feature_code
  || '","country_code":"' || country_code || '","adm1":"","adm2":"","adm3":"","adm4":""'
  || coalesce(',"elevation":' || elevation, '') || '},"distance":' || distance || '}' AS json"""

_ODD = """
odd AS (
  SELECT p_partkey,
         CASE p_partkey % 8 WHEN 0 THEN CAST(p_retailprice AS VARCHAR) WHEN 1 THEN ' ' || p_size || ' '
              WHEN 2 THEN p_type WHEN 3 THEN p_size || 'f' WHEN 4 THEN p_size || 'e2' WHEN 5 THEN '+' || p_size
              WHEN 6 THEN CAST(p_partkey * 40 AS VARCHAR) ELSE '' END AS text
  FROM part),
checked AS (
  SELECT p_partkey, text,
         CASE WHEN regexp_full_match(trim(text), '[+-]?[0-9]+(\\.[0-9]+)?(e[0-9]+)?')
              THEN CAST(CAST(trim(text) AS FLOAT) AS DOUBLE) END AS number
  FROM odd)
""".replace("\\\\", "\\")

ORACLES: dict[str, str] = {
    "scan_places": f"""WITH {_RAW}
SELECT CAST(id AS VARCHAR) AS id, name, ascii_name, CAST(CAST(latitude AS INT) AS VARCHAR) AS latitude,
  p_retailprice AS longitude, feature_class, feature_code, country_code,
  coalesce(CAST(elevation AS VARCHAR), '') AS elevation
FROM main JOIN part ON id = p_partkey""",
    "scan_alternates": f"""WITH {_RAW}
SELECT CAST(id AS VARCHAR) AS id, lang, name, CASE WHEN p THEN '1' ELSE '' END AS preferred,
  CASE WHEN s THEN '1' ELSE '' END AS short, CASE WHEN c THEN '1' ELSE '' END AS colloquial,
  CASE WHEN h THEN '1' ELSE '' END AS historic, vf AS valid_from, vt AS valid_to
FROM alt""",
    "multi_path_scan": f"""WITH {_RAW}
SELECT CAST(id AS VARCHAR) AS id, name, ascii_name FROM main UNION ALL {_SUPPLIERS}""",
    "compressed_scan": f"""WITH {_RAW}
SELECT CAST(id AS VARCHAR) AS id, name, ascii_name FROM main UNION ALL {_SUPPLIERS}""",
    "union_files": f"WITH {_RAW} SELECT term, type, id, 2 * count(*) AS n_pairs FROM pairs WHERE src = 0 GROUP BY ALL",
    "lenient_float": f"WITH {_ODD} SELECT p_partkey, number IS NULL AS is_nan, number AS value FROM checked",
    "lenient_smallint": f"""WITH {_ODD}
SELECT p_partkey, CASE WHEN regexp_full_match(text, '[+-]?[0-9]+') AND CAST(text AS BIGINT) BETWEEN -32768 AND 32767
  THEN CAST(text AS INT) END AS value FROM odd""",
    "classify_alternates": f"WITH {_RAW} SELECT name, type FROM alt_typed",
    "emit_terms": f"""WITH {_RAW}
SELECT term, type, id, lang, valid_from, valid_to, CAST(length(term) AS INTEGER) AS term_len FROM terms""",
    "type_ordinal": f"WITH {_RAW} SELECT type, ord, count(*) AS n_pairs FROM pairs GROUP BY ALL",
    "language_filter": f"""WITH {_RAW} SELECT term, type, id, lang FROM pairs
WHERE src = 1 AND lang IN ('building', 'machinery', 'automobile')""",
    "alternates_semi": f"WITH {_RAW} SELECT term, type, id FROM pairs WHERE src = 1",
    "places_last_wins": f"""WITH {_RAW}
SELECT id // 4 AS id, arg_max(name, id) AS name, arg_max(latitude, id) AS latitude,
  arg_max(longitude, id) AS longitude, arg_max(feature_class, id) AS feature_class,
  arg_max(feature_code, id) AS feature_code, arg_max(country_code, id) AS country_code,
  nullif(arg_max(coalesce(elevation, -1), id), -1) AS elevation
FROM main GROUP BY id // 4""",
    "posting_lists": f"""WITH {_RAW}
SELECT term, row_number() OVER (PARTITION BY term ORDER BY src, rowno, slot) AS position, type, id, lang
FROM terms""",
    "files_posting_lists": f"""WITH {_RAW}
SELECT term, row_number() OVER (PARTITION BY term ORDER BY rowno, slot) AS position, type, id FROM terms WHERE src = 0""",
    "mention_source": f"WITH {_MENTIONS} SELECT reference, text FROM mentions",
    "find": _search(f"t.term = '{NAME}'", None, "src, rowno, slot"),
    "find_in_order": _search(f"t.term = '{NAME}'", None, "src, rowno, slot").replace(
        'row_number() OVER (ORDER BY src, rowno, slot) AS "rank", ', ""
    ),
    "saved_find": _search(f"t.term = '{NAME}'", None, "src, rowno, slot"),
    "saved_starts_with": _starts("small ring"),
    "starts_with": _starts("small ring"),
    "starts_with_capped": _starts("small ring ECONOMY Brand#", cap=1),
    "fuzzy": _search("t.term LIKE '%s%m%r%n%g%B%#%2%'", _LENGTH_GAP.format(8), _BY_DISTANCE),
    "fuzzy_capped": _search(
        "t.term LIKE '%s%m%a%l%l%r%i%n%g%E%C%O%N%O%M%Y%B%r%a%n%d%#%2%' AND length(t.term) <= 27",
        _LENGTH_GAP.format(23),
        _BY_DISTANCE,
    ),
    "levenshtein": _search(
        "levenshtein(t.term, 'smxll ring ECONOMY Brand#2') <= 2",
        "CAST(levenshtein(t.term, 'smxll ring ECONOMY Brand#2') AS INTEGER)",
        _BY_DISTANCE,
    ),
    "regex": _search(
        "regexp_extract(t.term, '^small r(ing|od) [EP].*#1[0-9]?') = t.term",
        None,
        "ord, id, name, src, rowno, slot",
    ),
    "distance_column": f"""WITH {_RAW}
SELECT id AS p_partkey, CAST(levenshtein('{NAME}', name) AS INTEGER) AS distance FROM main""",
    "filter_class": _starts("small", "m.feature_class = 'E'"),
    "filter_code": _starts("small", "m.feature_code = 'ECONOMY'"),
    "filter_country": _starts("small", "m.country_code = 'Brand#2'"),
    "filter_conjunction": _starts(
        "small", "m.feature_class = 'E' AND m.feature_code = 'ECONOMY' AND m.country_code = 'Brand#2'"
    ),
    "find_word": _word_search("term = 'la'", None, "id, pos, slot"),
    "starts_with_word": _word_search(
        "starts_with(term, 'él') AND length(term) <= 6", "CAST(length(term) - 2 AS INTEGER)", f"distance, {_WORD_ORDER}"
    ),
    "fuzzy_word": _word_search(
        "regexp_matches(hex(encode(term)), '^(..)*C3(..)*A9(..)*74(..)*$')",
        f"CAST(levenshtein({_one_byte("'ét'")}, {_one_byte('term')}) AS INTEGER)",
        f"distance, {_WORD_ORDER}",
    ),
    "levenshtein_word": _word_search(
        _THE, "CAST(CASE WHEN term = 'the' THEN 0 ELSE 1 END AS INTEGER)", f"distance, {_WORD_ORDER}"
    ),
    "regex_word": _word_search(
        r"regexp_extract(term, '(?i)^é\p{L}+(tion|ment)') = term", None, _WORD_ORDER
    ),
    "tag_find_all": _tag(*_EXACT, "all"),
    "tag_find_first": _tag(*_EXACT, "first"),
    "tag_starts_with_all": _tag(*_PREFIX, "all"),
    "tag_starts_with_first": _tag(*_PREFIX, "first"),
    "tag_starts_with_capped_all": _tag(*_PREFIX_CAPPED, "all"),
    "tag_fuzzy_all": _tag(*_FUZZY, "all"),
    "tag_fuzzy_first": _tag(*_FUZZY, "first"),
    "tag_fuzzy_capped_all": _tag(*_FUZZY_CAPPED, "all"),
    "tag_levenshtein_all": _tag(*_edits(1), "all"),
    "tag_levenshtein_first": _tag(*_edits(1), "first"),
    "tag_levenshtein_two_first": _tag(*_edits(2), "first"),
    "tag_filtered_first": _tag(*_edits(1), "first", "m.feature_class = 'E'"),
    "tag_ranked": _tag(*_edits(1), "all", ranked=True),
    "tag_words_find_first": _tag_words(
        "SELECT text, term, CAST(0 AS INTEGER) AS distance FROM texts JOIN dictionary ON text = term",
        "id, pos, slot",
    ),
    "tag_words_starts_with_first": _tag_words(
        """SELECT text, term, CAST(length(term) - length(text) AS INTEGER) AS distance FROM texts JOIN (
             SELECT term, substr(term, 1, unnest(range(0, length(term) + 1))) AS prefix FROM dictionary
           ) ON text = prefix""",
        "met.distance, ord, id, term, pos, slot",
    ),
    "tag_words_levenshtein_first": _tag_words(_ONE_EDIT_APART, "met.distance, ord, id, term, pos, slot"),
    "saved_tag_find_first": _tag(*_EXACT, "first"),
    "saved_tag_levenshtein_first": _tag(*_edits(1), "first"),
    "saved_tag_levenshtein_all": _tag(*_edits(1), "all"),
    "saved_tag_starts_with_first": _tag(*_PREFIX, "first"),
    "saved_tag_fuzzy_first": _tag(*_FUZZY, "first"),
    "stream_tag_starts_with": _tag(*_PREFIX, "first").replace(_MENTIONS, _EVENT_MENTIONS),
    "stream_tag_levenshtein": _tag(*_edits(1), "first").replace(_MENTIONS, _EVENT_MENTIONS),
    "stream_tag_find": _tag(*_EXACT, "first").replace(_MENTIONS, _EVENT_MENTIONS),
    "catalogue_stats": f"""WITH {_RAW}
SELECT (SELECT count(*) FROM main) AS n_places, (SELECT count(DISTINCT term) FROM terms) AS n_terms""",
    "load_counters": f"""WITH {_RAW}
SELECT count(*) FILTER (WHERE src = 0) AS main_pairs, count(*) AS all_pairs FROM pairs""",
    "provenance": """SELECT 'placewright' AS "user", 'GeoNames Date: 2024-01-01; Languages: '
  || string_agg('''' || lang || '''', ', ' ORDER BY lang) AS comment
FROM (SELECT DISTINCT lower(c_mktsegment) AS lang FROM customer)""",
    "result_json": f"SELECT {_FLAT_JSON} FROM ({_tag(*_EXACT, 'first')})",
}
ORACLES["saved_regex"] = ORACLES["regex"]
ORACLES["response"] = f"""SELECT reference, name, id, (SELECT comment FROM ({ORACLES["provenance"]})) AS comment
FROM ({ORACLES["tag_find_first"]})"""
