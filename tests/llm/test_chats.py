import duckdb
import pandas as pd

from placewright.llm import oracles
from placewright.llm.chats import format_chats
from tests.compare import normalised

SCHEMA = "conv_id long, turn long, role string, text string, whole string, turns int, n_copies int"


def found(spark, rows):
    return format_chats(spark.createDataFrame([(*r, "w", 1, 2) for r in rows], SCHEMA)).toPandas()


def test_snapshots_collapse(spark):
    turns = [("system", "be kind"), ("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", "<|im_end|>")]
    rows = []
    for conv, n in ((1, 5), (2, 3), (3, 2), (4, 5), (5, 1), (6, 4)):
        rows += [(conv, i, *turns[i]) for i in range(n)]
    rows += [(7, i, *turns[i]) for i in range(3)] + [(7, 3, "user", "")]  # a null text is not an empty one
    rows += [(8, 0, None, "x"), (8, 0, None, "x"), (9, None, "user", "y"), (9, None, "user", "y"), (9, 1, "user", "z"), (None, 0, "user", "lost")]
    got = found(spark, rows)
    by_id = got.set_index("conv_id")
    assert sorted(by_id.index) == [1, 7, 8, 9]
    assert by_id.loc[1, "n_copies"] == 2 and by_id.loc[1, "n_turns"] == 5 and by_id.loc[8, "n_turns"] == 1
    assert by_id.loc[9, "rendered"] == "<|im_start|>user\ny<|im_end|>\n<|im_start|>user\nz<|im_end|>\n"
    assert by_id.loc[1, "rendered"].endswith("<|im_start|>assistant\n< |im_end|><|im_end|>\n")
    connection = duckdb.connect()
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    connection.register("conversations", table)
    assert normalised(got) == normalised(connection.execute(oracles.CHATS).df())


def test_no_rows(spark):
    assert len(found(spark, [])) == 0
