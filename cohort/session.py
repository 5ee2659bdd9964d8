"""Session helpers: a local session for tests and benchmarks, and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, name: str = "cohort", **conf) -> SparkSession:
    """A local session; on a cluster use the session the cluster gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # keep all cores busy on shuffles that are small for a cluster
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_made: list[str] = []     # what this process has written to the shared folder
_own: list[str] = []      # the temporary folder of local sessions without spark.checkpoint.dir


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path under the session's spark.checkpoint.dir; a temporary folder only on a local master without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="cohort-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = _own[0]
    _made.append(f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
    return _made[-1]


def remove_scratch(spark: SparkSession) -> int:
    """Delete what this process has written to the shared folder so far; frames that still read it are gone then.

    Results are lazy, so call it when they have been used: at the end of a job, or between jobs.
    """
    jvm, n = spark.sparkContext._jvm, 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def written(df: DataFrame, purpose: str = "table") -> DataFrame:
    """The same rows, written once to the shared folder and read back: cuts lineage and keeps columnar pruning."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, spread over all cores; any larger scan as it is.

    The rows that move are then less than one split per core, whatever the size of the cluster.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
