import random
import re

import pytest

from placewright.llm import line_dedup
from placewright.llm.line_dedup import dedup_lines, deduped
from tests.llm.helpers import documents, noisy, odd_rows


def words(line):
    return re.findall(r"[^\x20\x09-\x0D]+", line)


def near(a, b):
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    seen, out = [], {}
    for doc_id, text in sorted(rows):
        kept, gone = [], 0
        for line in [] if text is None else text.split("\n"):
            w = words(line)
            if w and any(w == s or near(w, s) for s in seen):
                gone += 1
            else:
                kept.append(line)
            seen.append(w)
        out[doc_id] = (None if text is None else "\n".join(kept), gone)
    return out


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_against_brute_force(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(line_dedup, "CHAIN", 16)
    rng = random.Random(3)
    base = [[rng.choice("abcde") for _ in range(rng.choice([1, 3, 5, 6, 7, 9, 100]))] for _ in range(14)]
    rows = []
    for i in range(60):
        lines = [" ".join(noisy(rng, rng.choice(base), list("abcde"), rng.choice([0, 0, 1, 1, 2]))) for _ in range(rng.randint(0, 5))]
        rows.append((i, rng.choice([*["\n".join(lines)] * 9, None])))
    got = {r.doc_id: (r.text, r.n_equal + r.n_near) for r in dedup_lines(documents(spark, [(*r, "s") for r in rows])).collect()}
    assert got == brute(rows)
    assert sum(n for _, n in got.values()) > 20


def test_many_lines_that_differ_in_one_place(spark):
    rows = [(i, f"Posted comment number {i} on this page") for i in range(400)]
    got = dedup_lines(documents(spark, [(*r, "s") for r in rows])).collect()
    assert [r.doc_id for r in got if r.text] == [0]


def test_odd_rows_keep_all_columns(spark):
    docs = documents(spark, odd_rows())
    done = deduped(docs)
    assert done.schema.simpleString() == docs.schema.simpleString()
    rows = done.collect()
    assert len(rows) == len(odd_rows())
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].text is None and by_id[2].text == "" and by_id[3].text == " \n\t "
    assert by_id[10].text == "line a b c d e\n" and by_id[10].n_chars == 15
    assert by_id[4].text == "one" and by_id[5].text == ""
    assert deduped(docs.limit(0)).count() == 0


def test_a_text_is_split_once_and_not_for_each_line(spark):
    rows = documents(spark, [(1, "one\none\ntwo", "s"), (2, "two\nthree\n\none", "s"), (3, None, "s")])
    plan = dedup_lines(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and "lambdafunction(split(" not in plan
    assert {r.doc_id: r.text for r in dedup_lines(rows).collect()} == {1: "one\ntwo", 2: "three\n", 3: None}
