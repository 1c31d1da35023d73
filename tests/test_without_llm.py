"""The library without its text subpackage: the contract module still
imports and registers everything else."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract_without_the_subpackage(tmp_path):
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = ("import __spark_entry__ as E; n = set(E.queries()); "
            "assert len(n) > 70 and not any(q.startswith('op') or q == 'pipeline' for q in n); "
            "assert set(E.oracle_sql()) <= n")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120,
                   env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})


def test_nothing_else_imports_the_subpackage():
    for folder in ("tidewater", "oracles", "tools"):
        for at, dirs, files in os.walk(os.path.join(ROOT, folder)):
            dirs[:] = [d for d in dirs if d not in ("llm", "__pycache__")]
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(at, f)) as text:
                        assert ".llm" not in text.read(), f
