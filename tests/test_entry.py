"""The driver's entry module, with and without the training-text subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as E

REPO = Path(E.__file__).resolve().parent


def test_names_match():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert "namespace_groups" in E.queries()


def test_without_the_subpackage(tmp_path):
    (tmp_path / "__spark_entry__.py").symlink_to(REPO / "__spark_entry__.py")
    (tmp_path / "textfacts").mkdir()
    for p in (REPO / "textfacts").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "textfacts" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'namespace_groups' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)
