"""The driver contract, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
TELL = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*sorted(q))"


@pytest.mark.parametrize("gone", [(), ("effectforge/llm", "tests/llm"), ("effectforge/llm", "tests/llm", "corpus_pipeline.py")])
def test_deleted_folders(tmp_path, gone):
    """What is left imports and registers its queries when the folders are deleted."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.exists():
            shutil.rmtree(path) if path.is_dir() else path.unlink()
    env = {"PYTHONPATH": str(copy), "PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", TELL], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    names = out.stdout.split()
    here = not gone and (REPO / "effectforge/llm").exists()
    assert ("op1_quality_rules" in names) == here and ("pipeline" in names) == here and "q04_ld_edges" in names
