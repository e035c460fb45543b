"""The entry points, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from corvane.plans import catalog

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "source_id", "doc_id", "text", "score", "rank"] and df.count() > 0


def test_the_rest_imports_alone(tmp_path):
    for part in ("corvane", "__spark_entry__.py"):
        source = ROOT / part
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / part)
    shutil.rmtree(tmp_path / "corvane/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'hybrid_search' in n and 'pipeline' not in n and not any(k.startswith('op1_') for k in n); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "corvane").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "corvane.llm" not in f.read_text(), f
