import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import cadence as cd
from pyspark.sql import functions as F
from tests.support import local_session

spark = local_session(2)
rows = spark.range(100).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"))
print("fired", cd.throttle(rows, "k", "t", seconds=10).count())
print("split", cd.throttle(rows, "k", "t", seconds=10, max_key_rows=5).count())
print("yaml", spark.range(1).select(cd.parse_yaml(F.lit("a: 1"))["doc"].alias("d")).first().d)
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    """Python workers start elsewhere and cannot import the package."""
    repo = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env,
        capture_output=True, text=True, timeout=240, check=False,
    )
    assert done.stdout.split("\n")[:3] == ["fired 10", "split 10", 'yaml {"a": 1}'], done.stderr[-2000:]
