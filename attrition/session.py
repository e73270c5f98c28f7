"""Session settings the operators are written for, and the shared work folder.

Nothing here is required by the operators themselves (they are plain
DataFrame functions); these are the settings a job using them should run with:

* ``spark.sql.session.timeZone=UTC`` — dates never shift with the host clock.
* AQE on, with partition coalescing and skew-join splitting, so the runtime
  picks broadcast vs. sort-merge from *measured* shuffle sizes and splits a
  hot key's partition instead of leaving it to one task.
* The Spark UI stays off.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF: dict[str, str] = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the call site of every expression costs more than planning them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Checkpointed intermediates are deleted once no DataFrame refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "attrition",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with ``DEFAULT_CONF``; ``master``/partitions only when given.

    On a cluster leave ``master`` unset (spark-submit decides) and size
    ``shuffle_partitions`` to the input: AQE coalesces small partitions but
    never splits a too-large initial one except for skewed joins.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir`` (or the context's checkpoint
    dir).  Only when neither is set *and* the master is local (tests, local
    runs) a fresh local folder is created and registered as the checkpoint
    dir; on a cluster a machine-local folder would not be shared, so that
    case raises instead.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's configuration decides
        sc = None
    configured = configured or (sc.getCheckpointDir() if sc is not None else None)
    if configured:
        return configured.rstrip("/")
    if sc is None or not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: configure a folder shared by all executors"
        )
    local = tempfile.mkdtemp(prefix="attrition-ckpt-")
    sc.setCheckpointDir(local)
    return os.path.abspath(sc.getCheckpointDir() or local).rstrip("/")
