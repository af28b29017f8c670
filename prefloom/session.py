"""Session helpers: local builder for tests/bench and a shared scratch location.

On a cluster the session is created by the platform; we only read from it.
Intermediate tables (model outputs, stream sinks) go under ``spark.checkpoint.dir``,
which must name a folder every executor sees. Only when it is unset (tests, local
bench) do we set one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "prefloom") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder. Only a local master gets one set for it (tests,
    local bench): on a cluster a folder of our choice would be a different one per machine."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master!r})")
        d = tempfile.mkdtemp(prefix="prefloom-ckpt-", dir=os.environ.get("PREFLOOM_LOCAL_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
    except Exception:  # remote session: only the SQL conf is used (written tables)
        pass
    return d


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path under the shared checkpoint folder for a written table."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the scratch tables this process has written so far; returns how many there
    were. Call it when no DataFrame that reads them is needed any more."""
    n = 0
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def recommended_conf(advisory_partition: str = "256m", max_split: str = "256m") -> dict[str, str]:
    """Session settings we recommend for large clusters (pass to the builder or the
    platform's job config; nothing here is applied to a running session).

    * AQE sizes post-shuffle partitions from measured map output (no fixed partition count
      to tune per scale) and splits skewed join partitions;
    * text tables: splits of ``max_split`` keep per-task regex/JSON work and sort buffers
      within executor memory;
    * broadcast joins only below the planner's size check (the library adds hints only for
      tables with a proven bound).
    """
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": advisory_partition,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": max_split,
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    }
