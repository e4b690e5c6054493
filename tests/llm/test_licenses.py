import random
import re

import pytest

from placewright.llm import licenses
from placewright.llm.licenses import Automaton, chains, license_summary, scan_licenses, scanned, words_of
from tests.llm.helpers import documents, odd_rows

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORDS.findall(lower)


def plain_base(text):
    """Places of the phrases by looking everywhere."""
    words, places = plain_words(text), []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return len(words), sorted(places)


def random_text(rng):
    pool = ["cc", "by", "CC", "general", "public", "license", "All", "rights", "reserved", "the", "mit", "x", "é", "CC BY-NC", "4.0", "İ"]
    return "".join(rng.choice(pool) + rng.choice([" ", "-", "\n", ", ", "_", "  "]) for _ in range(rng.randint(0, 60)))


def test_base_places_against_brute_force(spark):
    rng = random.Random(1)
    rows = odd_rows() + [(100 + i, random_text(rng), "s") for i in range(400)]
    rows += [(600, "all rights reserved " * 50_000, "s"), (601, "cc by" + " cc by" * 3, "s"), (602, "CC\x00BY ccby cc\x7fby", "s")]
    got = sorted(license_summary(documents(spark, rows)).collect(), key=repr)
    expected = []
    for doc_id, text, _ in rows:
        n, places = plain_base(text)
        starts = [i for i, _ in places]
        labels = ",".join(sorted({label for _, label in places}))
        expected.append((doc_id, n, len(places), min(starts, default=None), max(starts, default=None), labels))
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(map(repr, expected))
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert all(0 <= r.score <= 1 and (r.score == 1 or not r.n_base) for r in got)


def test_matching_statistics_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        templates = [("l", " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))) for _ in range(5)]
        automaton = Automaton(templates, {"a b": "p", "c": "q"})
        sequences = [t.split() for _, t in templates] + [["a", "b"], ["c"]]
        inside = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        words = [rng.choice("abcde") for _ in range(60)]
        found = {i: length for i, _, length in automaton.statistics([w.encode() for w in words])}
        for i in range(len(words)):
            longest = max((n for n in range(1, i + 2) if tuple(words[i - n + 1 : i + 1]) in inside), default=0)
            assert found.get(i, 0) == longest


def test_matches_are_all_runs(monkeypatch):
    """Every run along a template that cannot be made longer, in any template, not only the longest at a place."""
    rng = random.Random(3)
    for _ in range(60):
        templates = [("l", " ".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))) for _ in range(4)]
        words = [rng.choice("abcd") for _ in range(50)]
        _, matches = Automaton(templates, {}).scan([w.encode() for w in words])
        for number, (_, text) in enumerate(templates):
            t, expected = text.split(), set()
            for i in range(len(words)):
                for j in range(len(t)):
                    if i and j and words[i - 1] == t[j - 1]:
                        continue
                    n = 0
                    while i + n < len(words) and j + n < len(t) and words[i + n] == t[j + n]:
                        n += 1
                    if n >= licenses.MIN_MATCH:
                        expected.add((i, i + n - 1, j))
            assert {(m.start, m.end, m.at) for m in matches.get(number, [])} == expected


@pytest.mark.parametrize("number", range(len(licenses.TEMPLATES)))
def test_templates_are_found_within_text(number):
    label, text = licenses.TEMPLATES[number]
    automaton = Automaton(licenses.TEMPLATES, licenses.PHRASES)
    around = [f"w{i}" for i in range(40)]
    n, _, spans, score = scanned(automaton, " ".join([*around, text.upper(), *around]))
    size = len(words_of(text))
    assert n == 80 + size and score == 1
    assert (label, number, 40, 39 + size, 1.0) in spans


def test_changed_notices_are_still_found():
    automaton = Automaton(licenses.TEMPLATES, licenses.PHRASES)
    words = words_of(licenses.TEMPLATES[2][1])
    for at in (12, 25, 40):
        words[at] = b"other"
    words[30:30] = [b"some", b"more", b"words"]
    _, _, spans, score = scanned(automaton, b" ".join(words).decode())
    assert [s[0] for s in spans] == ["mit"] and 0.9 < score < 1 and (spans[0][2], spans[0][3]) == (0, len(words) - 1)
    _, _, spans, score = scanned(automaton, " ".join(w.decode() for w in words[:14]))
    assert not spans and 0.1 < score < 0.3
    assert scanned(automaton, "released under the house")[2:] == ([], 0.0)
    assert scanned(automaton, "released under the terms of the house")[3] < 0.2  # five words of a long one


def test_far_matches_are_not_chained():
    matches = [licenses.Match(0, 4, 0), licenses.Match(8, 12, 6), licenses.Match(60, 70, 12)]
    assert sorted(chains(matches)) == [(0, 12, 10), (60, 70, 11)]


def test_real_lines(spark):
    lines = {
        "Released under the MIT License.": "mit",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "Licensed under the Apache License, Version 2.0.": "apache",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "All rights reserved.": "reserved",
        "": "",
    }
    rows = [(i, f"Some words.\n{line}\nMore.", "s") for i, line in enumerate(lines)]
    got = {r.doc_id: r.labels for r in license_summary(documents(spark, rows)).collect()}
    assert [got[i] for i in range(len(lines))] == list(lines.values())


def test_own_templates_and_no_rows(spark):
    docs = documents(spark, [(1, "one two three four five", "s")])
    row = scan_licenses(docs, [("own", "two three four")], {"five": "end"}).first()
    assert [tuple(s) for s in row.spans] == [("own", 0, 1, 3, 1.0)] and [tuple(p) for p in row.places] == [("end", "five", 4)]
    assert license_summary(docs.limit(0)).count() == 0
