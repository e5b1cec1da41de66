"""Executors get the package, whatever the session and the driver's path."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

from tallyframe.llm import shipping

REPO = str(shipping.ROOT.parent)
SESSIONS = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import corpus_pipeline
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.executorEnv.PYTHONPATH", "/nowhere").config("spark.checkpoint.dir", "file://{tmp}/shared").getOrCreate()
sf = "/root/testdata/sf0.001"
rows = [corpus_pipeline.classifier(s, s.read.parquet(sf + "/documents.parquet"), sf).count() for s in (spark, spark.newSession())]
print("rows", rows[0] > 0 and rows[0] == rows[1])
spark.stop()
"""


def test_each_session_of_an_application_runs_the_classifier_on_executors(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": REPO, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_DIRS": str(tmp_path), "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", SESSIONS.format(repo=REPO, tmp=tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows True" in done.stdout, done.stderr[-3000:]


def test_sent_once_an_application_under_a_name_of_its_own(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(shipping, "_shipped", set(), raising=False)
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: sent.append(path))
    monkeypatch.setenv("PYTHONPATH", REPO)
    shipping.ship(spark)
    shipping.ship(spark.newSession())
    assert len(sent) == 1
    monkeypatch.setattr(shipping, "_shipped", set(), raising=False)
    shipping.ship(spark)
    assert len({os.path.basename(p) for p in sent}) == 2
