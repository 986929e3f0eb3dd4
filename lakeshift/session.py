"""Session helpers: a tuned local session for tests/bench and the shared scratch folder.

On a cluster the session is built by the platform; library code only *reads* its
settings.  ``scratch_root`` returns the shared folder named by ``spark.checkpoint.dir``
and sets a private one only when the setting is absent (local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "lakeshift", shuffle_partitions: int = 8, event_log_dir: str | None = None) -> SparkSession:
    """Local session for tests and the bench.  ``event_log_dir`` (or env
    ``LAKESHIFT_EVENT_LOG``) writes Spark's event log there for stage/task timings."""
    event_log_dir = event_log_dir or os.environ.get("LAKESHIFT_EVENT_LOG")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if event_log_dir:
        os.makedirs(event_log_dir, exist_ok=True)
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written tables.

    Reads ``spark.checkpoint.dir`` from the session (cluster setting).  Only a local master, whose tasks
    share the driver's disk, may leave it unset: a private folder is then created and registered.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="lakeshift-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.path.join(root, "rdd-checkpoints"))
    return root.rstrip("/")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh, unique path below the shared scratch root."""
    return "/".join([scratch_root(spark), *parts, uuid.uuid4().hex])
