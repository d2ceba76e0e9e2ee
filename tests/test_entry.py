"""The driver's contract, with and without the llm part."""

from __future__ import annotations

import pathlib
import shutil
import subprocess
import sys

import __spark_entry__
from tidemark import registry

REPO = pathlib.Path(__spark_entry__.__file__).parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert "total_sales_amount" in df.columns and df.count() > 0


def test_twins_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_llm_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries() if n[2].isdigit()))"
    for _ in range(2):
        run = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
        core = str(len(registry.queries()))  # all of the core, each with its twin, and no more
        assert run.stdout.split() == [core, core, "False"], run.stderr
        (copy / "tidemark" / "llm").mkdir(exist_ok=True)  # an empty folder left behind changes nothing
