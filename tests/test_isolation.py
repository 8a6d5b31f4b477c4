"""Without the training-data folders everything else still works, whether corpus_pipeline.py is left behind or not."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
import __spark_entry__ as entry
names = set(entry.queries())
assert names and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names), names
assert set(entry.oracle_sql()) <= names
assert not any(m.startswith("ridgewatch.llm") for m in sys.modules)
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_alone(tmp_path, pipeline):
    for name in ("ridgewatch", "__spark_entry__.py", *(["corpus_pipeline.py"] if (ROOT / "corpus_pipeline.py").exists() and pipeline else [])):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "ridgewatch" / "llm", ignore_errors=True)
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_subpackage():
    sources = [p for p in (ROOT / "ridgewatch").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert sources and not any("ridgewatch.llm" in p.read_text() for p in sources)
