"""The driver's contract: importable without a session, and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*q)"], cwd=folder, capture_output=True, text=True, check=True)
    return out.stdout.split()


def test_import_without_session():
    assert len(names(ROOT)) > 140


def test_import_without_optional_parts(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/treelake", tmp_path / "treelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    found = names(tmp_path)
    assert len(found) > 140 and not any(n.startswith("op") or n == "pipeline" for n in found)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
