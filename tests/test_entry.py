"""The entry file imports anywhere: no jar folder, no session."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import glob, sys
glob.glob = lambda *a, **k: []
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
queries, sql = entry.queries(), entry.oracle_sql()
assert set(sql) <= set(queries) and len(queries) > 140, len(queries)
from pyspark.sql import SparkSession
assert SparkSession.getActiveSession() is None
print("imported")
"""


def test_entry_imports_without_jars_or_session(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120,
    )
    assert done.returncode == 0, done.stderr
    assert "imported" in done.stdout
