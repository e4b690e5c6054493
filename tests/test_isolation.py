"""The registry without the folders that may be taken away."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("gone", [["llm"], ["llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]], ids=repr)
def test_import(tmp_path, gone):
    shutil.copytree(ROOT / "placewright", tmp_path / "placewright", ignore=shutil.ignore_patterns("__pycache__", *gone))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone and (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    ran = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert ran.returncode == 0, ran.stderr
    queries, oracles = ran.stdout.splitlines()[-2:]
    assert "tag_find_all" in queries and set(oracles.split()) <= set(queries.split())
    assert "pipeline" not in queries.split()
    assert ("op1_line_dedup" in queries) == ("llm" not in gone and (ROOT / "placewright" / "llm").exists())


def test_nothing_else_imports_the_subpackage():
    for file in (ROOT / "placewright").rglob("*.py"):
        if "llm" not in file.parts:
            assert "placewright.llm" not in file.read_text(), file
