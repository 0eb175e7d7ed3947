from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'q6_revenue' in q and set(o) <= set(q); print(sorted(x for x in q if x[:2] == 'op' or x == 'pipeline'))"


def run(folder: Path) -> str:
    done = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-800:]
    return done.stdout


def test_entry_with_and_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "rowsmith"):
        source = REPO / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "rowsmith" / "llm", ignore_errors=True)
    assert run(tmp_path).strip() == "[]"


def test_nothing_else_imports_the_subpackage():
    for p in (REPO / "rowsmith").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "rowsmith.llm" not in p.read_text()
