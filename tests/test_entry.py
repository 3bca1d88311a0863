"""The driver's contract, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["doc_id", "source", "quality", "status"]


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "docengine", tmp_path / "docengine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sum(k.startswith('op') and k[2].isdigit() for k in e.queries()), len(e.queries()) > 60, 'pipeline' in e.queries(), bool(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["0", "True", "False", "True"]


def test_nothing_else_imports_it():
    found = [p for p in (ROOT / "docengine").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts and "docengine.llm" in p.read_text()]
    assert found == []
