"""The driver loads __spark_entry__.py by path from its own working
directory; the package must import there and reach the Python workers."""

import os
import subprocess
import sys
import tempfile
from pathlib import Path

ENTRY = Path(__file__).resolve().parents[1] / "__spark_entry__.py"

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry_under_test", {str(ENTRY)!r})
E = importlib.util.module_from_spec(spec)
spec.loader.exec_module(E)
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
print("ROWS", E.queries()["html_select"](spark, "/root/testdata/sf0.001").count(), E.entry(spark).count())
"""


def test_entry_from_foreign_directory():
    cwd = tempfile.mkdtemp(prefix="tw-cwd-", dir="/tmp")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("ROWS")]
    assert line, out.stderr[-2000:]
    _, n_links, n_answers = line[0].split()
    assert int(n_links) > 0 and int(n_answers) == 10
