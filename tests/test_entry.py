"""The driver's entry works with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(k.startswith('op') for k in q), 'pipeline' in q)"


def said(folder):
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def copied(to, without):
    def skipped(folder, names):
        return [n for n in names if n in ("__pycache__", ".git") or os.path.relpath(os.path.join(folder, n), ROOT) in without]

    shutil.copytree(ROOT, to, ignore=skipped)
    return to


def test_registry_stands_alone(tmp_path):
    for i, without in enumerate((["scrivener/llm", "tests/llm"], ["scrivener/llm", "tests/llm", "corpus_pipeline.py"])):
        n, ops, pipeline = said(copied(tmp_path / str(i), without))
        assert int(n) > 250 and ops == "0" and pipeline == "False"
