"""Nothing outside the optional sub-package refers to it, and the entry works without it."""

import pathlib
import re
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent
OPTIONAL = "lectern." + "llm"


def test_no_reference_from_outside():
    for p in (ROOT / "lectern").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(rf"import.*{re.escape(OPTIONAL)}|from {re.escape(OPTIONAL)}", p.read_text()), p


def test_entry_without_it(tmp_path):
    shutil.copytree(ROOT / "lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dense_topk' in q and 'p2_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_core_works_without_it(tmp_path):
    """A part of the core tests passes in a copy without the optional folders, even where their compiled remains were left."""
    shutil.copytree(ROOT / "lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "lectern" / "llm" / "__pycache__").mkdir(parents=True)
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'p1_found' not in e.queries() and 'dense_topk' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_intervals.py", "tests/test_content.py"], cwd=tmp_path, check=True)
