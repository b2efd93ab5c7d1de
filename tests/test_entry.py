"""The entry module where the folders of the operators for training data have been taken away."""

import os
import shutil
import subprocess
import sys

from sentinela.registry import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(set(e.queries()) - set(e.QUERIES)))"


def copied(folder, *left_out):
    """The repository's code in ``folder``, less some of its paths."""
    gone = {os.path.join(ROOT, p) for p in left_out}

    def ignore(at, names):
        return [n for n in names if n.startswith(".") or n == "__pycache__" or os.path.join(at, n) in gone]

    shutil.copytree(ROOT, f"{folder}/copy", ignore=ignore)
    return f"{folder}/copy"


def said(at, folder):
    # Only the copy is on the path, so nothing that was left out comes from elsewhere.
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", SAY], cwd=at, env=env, capture_output=True, text=True, timeout=120)


def test_without_operators(folder):
    at = copied(folder, "sentinela/llm", "tests/llm")
    found = said(at, folder)
    assert found.returncode == 0, found.stderr
    assert found.stdout.split(maxsplit=2) == [str(len(QUERIES)), str(len(QUERIES)), "[]\n"]


def test_without_operators_and_pipeline(folder):
    found = said(copied(folder, "sentinela/llm", "tests/llm", "corpus_pipeline.py"), folder)
    assert found.returncode == 0 and found.stdout.startswith(f"{len(QUERIES)} {len(QUERIES)} []"), found.stderr


def test_errors_of_the_pipeline_are_not_swallowed(folder):
    at = copied(folder, "sentinela/llm/bpe.py")
    if os.path.isdir(f"{at}/sentinela/llm"):
        assert said(at, folder).returncode != 0
