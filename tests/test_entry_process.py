"""The driver loads __spark_entry__.py by path from its own working directory."""

import os
import subprocess
import sys

from conftest import ROOT, SF0001

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(ROOT, "__spark_entry__.py")!r})
m = importlib.util.module_from_spec(spec)
spec.loader.exec_module(m)
assert m.entry(spark).count() == 30
row = m.queries()["recovery_stats"](spark, {SF0001!r}).first()   # runs the Python model UDF
assert row.n_ambiguous_total == 297 and row.n_sampled == 297
print("OK")
"""


def test_entry_runs_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    assert "OK" in out.stdout
