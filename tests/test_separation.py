from __future__ import annotations

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert 'knn_exact_l2' in q and set(o) <= set(q) and 'pipeline' not in q and not any(n.startswith('op') for n in q), sorted(q)
"""


def test_the_rest_stands_without_the_text_operators(tmp_path):
    """With the text operators and their tests deleted, and with the pipeline there or gone, the entry still gives all other queries."""
    for gone in ((), ("corpus_pipeline.py",)):
        copy = tmp_path / f"copy{len(gone)}"
        shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
        shutil.rmtree(copy / "quillvec" / "llm", ignore_errors=True)
        shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
        for name in gone:
            (copy / name).unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr[-2000:]
