"""A query on executors that are processes of their own, where an embedded database is the driver's alone."""

from __future__ import annotations

import os
import subprocess
import sys

from compare import DATA
from conftest import ROOT

CODE = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
import __spark_entry__
from compare import duck, same
print("found:", same(__spark_entry__.queries()["database_tables"](spark, sys.argv[2]), duck(sys.argv[2]), __spark_entry__.oracle_sql()["database_tables"]) or "the same")
spark.stop()
"""


def test_database_tables_of_the_driver(tmp_path):
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{ROOT}/tests"}
    run = subprocess.run([sys.executable, "-c", CODE, str(tmp_path), str(DATA / "sf0.001")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "found: the same" in run.stdout, run.stderr[-2000:]
