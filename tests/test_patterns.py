"""Regular expressions: acceptance, dialect, refusals."""

import random

import pytest
from pyspark.sql import functions as F

from placewright import regex
from placewright.functions.matching import ends_with_match, has_subsequence, is_subsequence
from placewright.functions.patterns import required_literals, translate
from tests import brute

ACCEPTED = [
    ("^Frankfurt.*", "Frankfurt am Main"),
    ("furt", "Frankfurt"),
    ("ab|a", "ab"),
    ("(?i)FRANK.*", "Frankfurt"),
    (r"\w+", "Größe"),
    (r"^\p{L}+$", "Größe"),
    (r"\p{Greek}+", "αβγ"),
    (r"\pL\d", "é٣"),
    ("b$", "ab"),
    ("a|b$", "b"),
    ("(?P<name>a)(?<other>b)", "ab"),
    ("[[:alpha:]]+", "abc"),
    ("[]a]+", "a]a"),
    ("a{2,}", "aaa"),
    (r"\x{e9}\u{e9}", "éé"),
    (r"\$", "a$"),
    ("[$]", "a$"),
    ("(?s).+", "a\nb"),
]
REFUSED_TERMS = [
    ("Frank", "Frankfurt"),
    ("Frank", "FrankFrank"),
    ("a|ab", "ab"),
    ("a.*?", "abc"),
    ("a*", "bbb"),
    ("a.+", "a\nb"),
    ("b$", "ab\n"),
    ("[[:alpha:]]+", "é"),
]


@pytest.mark.parametrize(("pattern", "term", "accepted"), [(*c, True) for c in ACCEPTED] + [(*c, False) for c in REFUSED_TERMS])
def test_acceptance(spark, pattern, term, accepted):
    row = spark.createDataFrame([(term,)], "term string").select(ends_with_match(F.col("term"), pattern)).first()
    assert row[0] is accepted


@pytest.mark.parametrize(
    "pattern",
    [r"(?=a)", r"(?!a)", r"(?<=a)b", r"(?<!a)b", r"(?>a)", r"(a)\1", r"\bword", r"a++", r"a{", "[a", r"\Qa\E", r"\Z", r"\h", "[a--b]", "(?U)a*", "[[:nope:]]"],
)
def test_refused_patterns(pattern):
    with pytest.raises(ValueError, match="(?i)unsupported|not supported|unclosed|unescaped|unknown"):
        translate(pattern)


@pytest.mark.parametrize("pattern", ["(a", "a)", "*a", "[z-a]", r"\p{Nope}", "a**"])
def test_invalid_patterns(gazetteer, pattern):
    with pytest.raises(ValueError, match="invalid regular expression"):
        regex(gazetteer, pattern)


def test_subsequences(spark):
    words = ["", "a", "ä", "üФ", "aä", "[x]", "a.b", "\\", "x\ny", "aaaaaaaaaaaaaaaaaaaaaaaab", "中文"]
    frame = spark.createDataFrame([(w,) for w in words], "whole string")
    for part in words:
        expected = sorted(w for w in words if brute.contains(w, part))
        assert sorted(r.whole for r in frame.filter(has_subsequence(F.col("whole"), part)).collect()) == expected
    both = frame.crossJoin(frame.select(F.col("whole").alias("part")))
    found = both.filter(is_subsequence(F.col("part"), F.col("whole"))).collect()
    assert sorted((r.part, r.whole) for r in found) == sorted(
        (p, w) for p in words for w in words if brute.contains(w, p)
    )


def test_bytes_not_characters(spark):
    frame = spark.createDataFrame([("üФ",)], "whole string")
    assert frame.filter(has_subsequence(F.col("whole"), "ä")).count() == 1


@pytest.mark.parametrize(
    ("pattern", "expected"),
    [
        ("^small r(ing|od) [EP].*#1[0-9]?", ("small r", [" ", "#1"])),
        ("^abc", ("abc", [])),
        ("abc$", ("", ["abc"])),
        ("^ab?c+d{2,}e{0,1}f", ("a", ["c", "d", "f"])),
        ("^(a|b)c", ("", ["c"])),
        ("^a|b", ("", [])),
        ("^(?:x(y)z)?a[bc]d", ("", ["a", "d"])),
        ("(?i)^abc", ("", [])),
        ("^[]a]bc", ("", [])),
        (r"^a\.b\d\$c", ("a.b", ["$c"])),
        (r"^\x{e9}ab", ("", ["ab"])),
        ("^[[:alpha:]x]ab", ("", ["ab"])),
        ("x*", ("", [])),
        ("", ("", [])),
    ],
)
def test_required_literals(pattern, expected):
    assert required_literals(pattern) == expected


def test_literals_lose_no_match(spark):
    """Whatever matches has the literals, for patterns put together from pieces."""
    rng = random.Random(4)
    pieces = ["a", "b", "ab", "a?", "b*", "a+", "(a|b)", "(?:ab)?", "[ab]", ".", "b{2}", "a{0,1}", "b{1,2}", "[^a]", r"\.", "(b|)", "$"]
    strings = ["".join(rng.choices("ab.", k=rng.randint(0, 7))) for _ in range(300)]
    table = spark.createDataFrame([(s,) for s in strings], "term string").cache()
    for _ in range(40):
        pattern = rng.choice(["", "^"]) + "".join(rng.choices(pieces, k=rng.randint(1, 5)))
        prefix, inner = required_literals(pattern)
        matched = [r.term for r in table.where(ends_with_match(F.col("term"), pattern)).collect()]
        assert all(t.startswith(prefix) and all(i in t for i in inner) for t in matched), pattern
    table.unpersist()


def test_prefix_reaches_the_scan(spark, gazetteer):
    plan = regex(gazetteer, "^Frank(furt|en).*")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,Frank)" in plan
    assert regex(gazetteer, "^Frank(furt|en).*").count() == regex(gazetteer, "Frank(furt|en).*").count() > 0
