"""The rest of the library without the training-data part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as entry
from quern import catalogue
assert set(entry.queries()) == set(catalogue.QUERIES) | set(catalogue.WITHOUT_SQL)
assert entry.oracle_sql() == catalogue.ORACLES
"""


@pytest.mark.parametrize("gone", [["quern/llm"], ["quern/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_what_is_left_still_loads(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        path = tmp_path / "repo" / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = CODE if "quern/llm" in gone else "import __spark_entry__ as entry; assert 'pipeline' not in entry.queries() and 'pipeline' not in entry.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})
