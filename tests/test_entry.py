"""The driver contract, and the library without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 70


def test_runs_without_the_corpus_operators(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(q.startswith('op1') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    for path in (REPO / "tessella").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "tessella.llm" not in path.read_text(), path
