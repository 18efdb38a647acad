"""The session's folder and packaging, in processes of their own."""

import os
import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parents[1])
SCRIPT = """
import os, sys
sys.path.insert(0, {repo!r})
from siltstone.runtime import SHARED, release, session, settle, shared_dir, table
spark = session("2")
assert spark.conf.get("spark.checkpoint.dir", None) is None, "the folder is preset"
kept = settle(spark.range(10), "ten")
where = spark.conf.get(SHARED)
assert kept.count() == 10 and shared_dir(spark) == where
table(spark, {data!r}, "nation")
from pyspark.sql.functions import pandas_udf
import siltstone.functions.text as text
rows = spark.range(3).mapInPandas(lambda frames: (f.assign(id=len(text.WORD)) for f in frames), "id long").collect()
assert len(rows) == 3
assert release(spark) == 1 and release(spark) == 0 and os.listdir(where[7:]) == []
print("fine")
"""


def test_settling_without_a_preset_folder(tmp_path):
    (tmp_path / "conf").mkdir()
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")} | {"SPARK_CONF_DIR": str(tmp_path / "conf")}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, data="/root/testdata/sf0.001")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stdout + done.stderr[-2000:]


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    import pytest

    from siltstone import runtime

    class Conf:
        def get(self, name, default=None):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://somewhere"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Cluster())
