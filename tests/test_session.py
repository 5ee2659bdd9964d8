"""The shared folder of sessions with and without the setting."""

import os
import subprocess
import sys

import pytest

from cohort import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_a_plain_local_session_writes_to_one_temporary_folder(tmp_path):
    """In a process of its own, with an empty configuration folder, as the option cannot be taken back."""
    code = """
import os
from pyspark.sql import SparkSession
from cohort import session
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert session.written(spark.range(5)).count() == 5 and session.written(spark.range(3), "more").count() == 3
assert len({os.path.dirname(p) for p in session._made}) == 1 and spark.conf.get("spark.checkpoint.dir", None) is None
folder = session._own[0]
assert session.remove_scratch(spark) == 2 and os.listdir(folder) == []
print("FOLDER", folder)
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_CONF", "PYSPARK_SUBMIT"))}
    done = subprocess.run([sys.executable, "-c", code], env=env | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT},
                          capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not os.path.exists(done.stdout.split("FOLDER")[1].strip())


def test_clusters_need_the_setting():
    class Bare:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "local-cluster[2,1,1024]"})

    with pytest.raises(ValueError):
        session.shared_folder(Bare, "x")


def test_the_setting_is_used(spark):
    class Set:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: "file:///shared/")})
        sparkContext = type("Context", (), {"master": "spark://somewhere"})

    path = session.shared_folder(Set, "x")
    session._made.remove(path)
    assert path.startswith("file:///shared/x-")
