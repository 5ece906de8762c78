import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from ripplegrid import registry


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("gone", [["ripplegrid/llm", "tests/llm", "corpus_pipeline.py"], ["ripplegrid/llm", "tests/llm"]])
def test_the_library_stands_without_its_extra_part(tmp_path, gone):
    root = Path(__spark_entry__.__file__).parent
    copy = shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink()
    code = "import __spark_entry__ as e, ripplegrid.registry as r; assert e.__file__.startswith(%r); assert set(e.queries()) == set(r.queries()) and set(e.oracle_sql()) == set(r.oracle_sql()); from pyspark.sql import SparkSession; print('ROWS', e.entry(SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()).count())"
    said = subprocess.run([sys.executable, "-B", "-c", code % str(copy)], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert "ROWS 9" in said.stdout, said.stderr[-2000:]


def test_nothing_else_imports_the_extra_part():
    root = Path(registry.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"llm", p.read_text())]


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0
