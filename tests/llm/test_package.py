"""Executors get one package, whichever query runs first."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as E
from threadlens.session import get_spark
spark = get_spark("local[2]", shuffle_partitions=2)
sf = "/root/testdata/sf0.001"
n = [E.queries()[q](spark, sf).count() for q in ("op1_language_id", "k6_isolation_forest", "op1_language_id")]
assert n[0] == n[2] == spark.read.parquet(f"{sf}/documents.parquet").count() and n[1] > 0, n
"""


def test_forest_after_a_corpus_query_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, REPO], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
