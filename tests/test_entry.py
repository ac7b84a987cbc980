"""The entry point, whole and without the text operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*sorted(q))"


def names(folder):
    found = subprocess.run([sys.executable, "-c", LIST], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr[-2000:]
    return set(found.stdout.split())


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_text_operators(tmp_path):
    """With the folders gone, with or without corpus_pipeline.py, and with what a deleted folder may leave behind."""
    shutil.copytree(ROOT / "sonarframe", tmp_path / "sonarframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    core = names(tmp_path)
    assert "speech_seconds" in core and not [n for n in core if n.startswith("op") or n == "pipeline"]
    (tmp_path / "sonarframe" / "llm" / "__pycache__").mkdir(parents=True)
    assert names(tmp_path) == core
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(tmp_path) == core
