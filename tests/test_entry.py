"""The driver's contract, with and without the llm subpackage."""

import os
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))


def test_rest_stands_alone(tmp_path):
    """Without the llm subpackage and the pipeline the entry still imports and has all other queries; nothing else names them."""
    shutil.copytree(f"{ROOT}/skein", tmp_path / "skein", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 50 and out[1:] == ["False", "True"]
    for folder, _, files in os.walk(tmp_path / "skein"):
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as source:
                    assert not re.search(r"skein\.llm|corpus_pipeline", source.read()), f


@pytest.mark.skipif(not os.path.isdir(__spark_entry__.SMOKE_DIR), reason="no test data")
def test_flagship(spark):
    rows = {r.status: (r.jobs, r.future_moves) for r in __spark_entry__.entry(spark).collect()}
    assert rows == {"moved": (226, 21), "pending": (23, 0), "quiet": (881, 0), "not_quoted": (370, rows["not_quoted"][1])}
