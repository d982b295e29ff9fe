"""The driver's contract holds with and without the parts that may be removed."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 45


@pytest.mark.parametrize("gone", [("scenelake/llm", "tests/llm"), ("scenelake/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_parts_removed(tmp_path, gone):
    """A copy without them imports and lists the other queries."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", ".pytest_cache"))
    for g in gone:
        shutil.rmtree(copy / g) if (copy / g).is_dir() else (copy / g).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(n for n in e.queries() if n.startswith('op') and n[2].isdigit() or n == 'pipeline'))"
    env = {**os.environ, "PYTHONPATH": str(copy), "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, _, left = out.stdout.strip().split(" ", 2)
    assert int(n) >= 45
    assert "pipeline" not in left
    assert ("op1_" in left) == ((REPO / "scenelake/llm").is_dir() and "scenelake/llm" not in gone)
