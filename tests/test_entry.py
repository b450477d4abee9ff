"""The library stands without its pipeline operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import __spark_entry__ as e
names = e.queries()
assert names and not [n for n in names if n.startswith("op") and "_" in n and n[2].isdigit()], names
assert "pipeline" not in names and set(e.oracle_sql()) <= set(names)
from demoforge.session import local_session
spark = local_session("2", partitions=2)
assert names["first_n"](spark, "/root/testdata/sf0.001").count() > 0
print("stands alone")
"""


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_imports_without_the_pipeline_operators(tmp_path, pipeline_too):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", *(["corpus_pipeline.py"] if pipeline_too else []))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "stands alone" in done.stdout, done.stderr[-2000:]
