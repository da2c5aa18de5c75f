"""The library without the corpus operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_corpus_operators(tmp_path):
    ignore = shutil.ignore_patterns("llm", "__pycache__", ".git", "corpus_pipeline.py")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=ignore)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": ""})


def test_nothing_else_imports_them():
    for folder, _, files in os.walk(os.path.join(ROOT, "tidelog")):
        for name in files:
            if name.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, name)) as file:
                    assert "llm" not in file.read(), name
