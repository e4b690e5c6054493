"""Small tables for the operators: all odd cases at once, and columns whose names could clash."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, row string, `group` long, gone long, part long, times int, size long, copy int"


def documents(spark: SparkSession, rows: list[tuple], schema: str = SCHEMA) -> DataFrame:
    """Rows of (doc_id, text, source), the other columns filled."""
    full = [(i, t, "en", s, None if t is None else len(t), 1, "r", 2, 3, 4, 5, 6, 7) for i, t, s in rows]
    return spark.createDataFrame(full, schema)


def odd_rows() -> list[tuple]:
    """Null and empty texts, blanks, null ids and sources, repeated rows and ids, a long text, copies."""
    long_text = " ".join(f"long{i % 977}" for i in range(30_000))
    return [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \n\t ", "b"),
        (4, "one", None),
        (5, "one", None),
        (5, "one", None),
        (6, "one two three four five six seven eight nine ten", "b"),
        (6, "something else with the same id here now", "b"),
        (None, "one two three four five six seven eight nine ten", "b"),
        (None, None, None),
        (7, long_text, "a"),
        (8, long_text + " end", "a"),
        (9, "é☃😀 ünï\x00 tail", ""),
        (10, "line a b c d e\nline a b c d f\n\nline a b c d e", "a"),
    ]


def noisy(rng: random.Random, words: list[str], vocabulary: list[str], edits: int) -> list[str]:
    out = list(words)
    for _ in range(edits):
        kind = rng.random()
        if not out or kind < 0.3:
            out.insert(rng.randint(0, len(out)), rng.choice(vocabulary))
        elif kind < 0.6:
            out.pop(rng.randrange(len(out)))
        else:
            out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return out
