"""The engine stands without the training-data operators."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SKIPPED = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_llm(tmp_path, pipeline):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=SKIPPED)
    if not pipeline:
        (tmp_path / "repo" / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) >= 67 and set(s) <= set(q); assert not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr


def test_engine_does_not_import_llm():
    for path in (ROOT / "millrace").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_other_import_errors_are_raised(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=SKIPPED)
    (tmp_path / "repo" / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert run.returncode != 0 and "no_such_module_at_all" in run.stderr
