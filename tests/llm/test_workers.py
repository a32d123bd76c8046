"""Every operator and the pipeline run where Python workers can't import this package."""

import os
import subprocess
import sys

RUN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
import __spark_entry__

def known(_):
    import importlib.util
    yield importlib.util.find_spec("kelpline") is not None

assert spark.sparkContext.parallelize([0], 1).mapPartitions(known).collect() == [False]
found = __spark_entry__.queries()
for name in [n for n in found if n.startswith("op")] + ["pipeline"]:
    assert found[name](spark, {data!r}).count() >= (name != "op2_secret_forest"), name
print("all ran")
"""


def test_workers_need_no_copy(data, tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", RUN.format(repo=repo, shared=str(tmp_path / "shared"), data=data)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in run.stdout, run.stderr[-3000:]
