"""Session construction and the shared scratch folder.

Cluster jobs never use a machine-local temporary folder: scratch data (stream sources,
sinks, checkpoints, lineage cuts) lives under the folder named by ``spark.checkpoint.dir``.
Only when the session has none (local tests) do we set one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CKPT_KEY = "spark.checkpoint.dir"
BROADCAST_BYTES = 16 << 20


def get_spark(master: str | None = None, app: str = "corpusflow",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    - UTC session zone; timestamps without zone stay TIMESTAMP_NTZ end to end.
    - AQE on: runtime coalescing, skew-join splitting, and runtime broadcast conversion
      only when a *measured* shuffle side is below ``autoBroadcastJoinThreshold``.
    - No web UI.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.timestampType": "TIMESTAMP_NTZ",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only if none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get(_CKPT_KEY, None) or spark.conf.get(_CKPT_KEY, None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {_CKPT_KEY} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="corpusflow-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder path under the shared checkpoint folder (not created)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def bound_batches(spark: SparkSession, n_bytes: int = 8 << 20, rows: int = 4096) -> None:
    """Bound the Arrow batches sent to Python by bytes as well as rows, whatever the size of a partition."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def broadcast_checked(side: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``side`` with a broadcast hint if its rows take at most ``limit`` bytes as JSON text; beyond
    that the join is left to the optimizer. Measures ``side``: pass a written or checkpointed table."""
    size = side.select(F.sum(F.length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0
    return F.broadcast(side) if size <= limit else side


def local_path(path: str) -> str:
    """``file:`` URI -> plain local path (for Python-side file I/O in tests and tools)."""
    return path[len("file:"):] if path.startswith("file:") else path
