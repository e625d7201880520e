"""Executors need no copy of the package: a run whose workers cannot import it."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from veilwork import runtime

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
import __spark_entry__
def away(batches):
    import importlib.util
    for b in batches:
        assert importlib.util.find_spec("veilwork") is None
        yield b
spark.range(1).mapInArrow(away, "id long").count()
for q in {names!r}:
    print(q, __spark_entry__.queries()[q](spark, "/root/testdata/sf0.001").count())
"""


def run_away(tmp_path, names):
    repo = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(repo=repo, names=names, shared=f"file://{tmp_path}")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    return out.stdout


def test_core_queries_run_where_workers_lack_the_package(tmp_path):
    assert "semeval_modes" in run_away(tmp_path, ["semeval_modes", "audit_chain"])


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"

    class Session:
        sparkContext = Cluster()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: None)})()

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())


def test_staged_tables_are_freed(spark):
    with runtime.staging():
        one = runtime.stage(spark.range(5))
        two = runtime.stage(spark.range(6))
        runtime.drop(one)
        assert two.count() == 6 and one._staged_path not in runtime._staged
    assert two._staged_path not in runtime._staged


def test_large_sides_are_not_broadcast(spark):
    small, big = runtime.stage(spark.range(1000)), spark.range(10_000)
    plan = lambda **o: runtime.join_sized(big, small, "id", **o)._jdf.queryExecution().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan() and "BroadcastHashJoin" not in plan(limit_bytes=4000)
        assert runtime.join_sized(big, small, "id", limit_bytes=4000).count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
