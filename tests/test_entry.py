"""The driver's entry point with the training-data folders there, absent and broken."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; print('NAMES', len(e.queries()), *sorted(set(e.oracle_sql()) - set(e.queries())))"


def names(at: Path) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=at, env={"PATH": "", "PYTHONPATH": ":".join([str(at), *sys.path])}, capture_output=True, text=True)


@pytest.fixture
def without(tmp_path):
    """A copy of the library without the training-data subpackage and the pipeline."""
    shutil.copytree(REPO / "vertexloom", tmp_path / "vertexloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_graph_queries_stand_alone(without):
    from vertexloom.queries import ORACLE_SQL, QUERIES

    done = names(without)
    assert done.returncode == 0 and done.stdout.split()[-1] == str(len(QUERIES)), done.stderr
    assert set(ORACLE_SQL) == set(QUERIES)


def test_errors_inside_are_raised(without):
    (without / "vertexloom/llm").mkdir()
    (without / "vertexloom/llm/__init__.py").write_text("")
    (without / "vertexloom/llm/registry.py").write_text("import not_there_at_all\n")
    done = names(without)
    assert done.returncode and "not_there_at_all" in done.stderr
