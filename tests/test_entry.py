"""The entry module with and without the parts that may be missing."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q) and "flagship" in q and len(q) >= 73
assert not any(k.startswith("op") or k == "pipeline" for k in q)
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_relational_queries_remain_without_the_subpackage(tmp_path, pipeline):
    shutil.copytree(HERE / "lakemill", tmp_path / "lakemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and (HERE / "corpus_pipeline.py").exists()):
        shutil.copy(HERE / name, tmp_path)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
