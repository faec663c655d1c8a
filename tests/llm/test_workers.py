"""Tasks need no copy of the package: the queries that run Python on executors
work from a folder and a path that do not hold it."""

import os
import subprocess
import sys

from conftest import ROOT

RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
from thali.llm.queries import QUERIES
for key in ("op1_simhash", "op3_lm_score", "op4_language_id", "op5_byte_bpe", "op8_mixing"):
    assert QUERIES[key](spark, "/root/testdata/sf0.001").count() == 200, key
    QUERIES[key](spark, "/root/testdata/sf0.001").collect()
print("all ran")
"""


def test_python_queries_run_from_elsewhere(scratch):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTEST_CURRENT_TEST")}
    done = subprocess.run([sys.executable, "-c", RUN, ROOT, scratch], cwd=scratch, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-2000:]
