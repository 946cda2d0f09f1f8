"""The driver's contract: names, and that all but the pipeline's operators works without them."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_twin_has_its_query():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and all(callable(q) for q in names.values())


def test_the_rest_imports_without_the_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json"))
    code = "import __spark_entry__ as e, bench; n = e.queries(); s = e.oracle_sql(); assert set(s) <= set(n) and len(n) > 60 and not any(x.startswith('op1') for x in n)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
