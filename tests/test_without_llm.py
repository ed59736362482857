import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_works_without_the_llm_subpackage(tmp_path, pipeline):
    shutil.copytree(ROOT / "barograph", tmp_path / "barograph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * pipeline:
        shutil.copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    queries, oracles, has_llm = out.stdout.split()
    assert int(queries) == int(oracles) > 40 and has_llm == "False"


def test_nothing_else_imports_llm():
    for path in (ROOT / "barograph").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text()
