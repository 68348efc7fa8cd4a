"""What only shows where executors are other machines."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from ledgerlake.llm import common

REPO = Path(__file__).resolve().parents[2]

#: Run in a folder from which workers can't import the package; the driver can.
JOB = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from ledgerlake.session import session
from ledgerlake.llm import langid, line_dedup, near_dedup, queries, records, toxicity, topk
from ledgerlake.llm.common import table
s = session("bare", cpus=2, **{{"spark.checkpoint.dir": "file://" + sys.argv[1] + "/shared", "spark.local.dir": sys.argv[1]}})
def absent(_):
    import importlib.util
    return [importlib.util.find_spec("ledgerlake") is None]
assert s.sparkContext.parallelize([0], 1).mapPartitions(absent).first()
docs = table(s, "/root/testdata/sf0.001", "documents")
for f in (queries.op4_toxicity, queries.op6_language_id, queries.op3_near_dedup, queries.op10_records, queries.op1_sharding):
    assert f(s, "/root/testdata/sf0.001").count() == docs.count(), f
for f in (queries.op11_prefix_trie, queries.op12_spelling, queries.op13_html_text):
    assert f(s, "/root/testdata/sf0.001").count() > 0, f
print("done")
"""


def test_executors_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "SPARK_ENV_LOADED")}
    env["PYTHONPATH"] = os.pathsep.join(p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != REPO)
    out = subprocess.run([sys.executable, "-c", JOB, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0 and out.stdout.strip().endswith("done"), out.stderr[-3000:]


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": lambda self, key, default: default})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())
    assert common.shared_folder(spark).startswith("file:")
