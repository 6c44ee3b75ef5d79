"""The library without its training-data package, as a copy: everything else imports and keeps its queries."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; from workload.catalog import QUERIES; assert set(e.queries()) == set(QUERIES) == set(e.oracle_sql()); print(len(QUERIES))"


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_entry_points_import_without_the_package(tmp_path, pipeline_too):
    for name in ("lodestone", "workload"):
        shutil.copytree(f"{REPO}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    if not pipeline_too and os.path.exists(f"{REPO}/corpus_pipeline.py"):
        shutil.copy(f"{REPO}/corpus_pipeline.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) > 100, done.stderr
