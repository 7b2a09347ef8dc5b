"""The library without its corpus operators: the driver may delete both folders."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def listed(folder) -> set[str]:
    code = "import __spark_entry__ as e; print(*sorted(set(e.queries()) | set(e.oracle_sql())))"
    return set(subprocess.run([sys.executable, "-c", code], cwd=folder, check=True, capture_output=True, text=True).stdout.split())


def test_queries_are_listed_without_corpus_operators(tmp_path):
    for name in ("scriptorium", "__spark_entry__.py", "corpus_pipeline.py"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        if (ROOT / name).exists():
            copy(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "scriptorium" / "llm", ignore_errors=True)
    left = listed(tmp_path)
    assert "bias_list" in left and "pipeline" not in left
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert listed(tmp_path) == left
