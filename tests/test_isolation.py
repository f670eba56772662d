"""The package without its subpackage for corpora, and with a half of it."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), sum(n.startswith('op') or n == 'pipeline' for n in q))"
IMPORTS = "import glob, importlib, os; [importlib.import_module('tests.' + os.path.basename(f)[:-3]) for f in glob.glob('tests/test_*.py')]"


def run(where, code):
    done = subprocess.run([sys.executable, "-c", code], cwd=where, env=os.environ | {"PYTHONPATH": str(where)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def copy(tmp_path, *without):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse", "metastore_db"))
    for name in without:
        at = tmp_path / "copy" / name
        if at.is_dir():
            shutil.rmtree(at)
        elif at.exists():
            at.unlink()
    return tmp_path / "copy"


def test_without_the_subpackage(tmp_path):
    at = copy(tmp_path, "harrow/llm", "tests/llm")
    n, sql, of_llm = run(at, SAYS)
    assert int(n) >= 50 and int(sql) >= 48 and of_llm == "0"
    run(at, IMPORTS)


def test_without_the_subpackage_and_the_pipeline(tmp_path):
    at = copy(tmp_path, "harrow/llm", "tests/llm", "corpus_pipeline.py")
    assert run(at, SAYS)[2] == "0"


def test_where_the_subpackage_lacks_a_dependency(tmp_path):
    at = copy(tmp_path)
    (at / "xxhash.py").write_text("raise ImportError('not here')\n")
    assert run(at, SAYS)[2] == "0"
