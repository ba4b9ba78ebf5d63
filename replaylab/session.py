"""Session helpers.

The library never creates a cluster session on its own: it reads whatever the
caller built.  ``local_session`` exists for tests, the bench and the smoke
entry point only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Engine contract: event times are UTC instants, month/day buckets are UTC.
SESSION_TZ = "UTC"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings every query of the library relies on."""
    spark.conf.set("spark.sql.session.timeZone", SESSION_TZ)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared lineage-cut folder named by ``spark.checkpoint.dir``.

    Set our own (a scratch folder) only when the session has none AND runs in
    local mode, as in tests; on a cluster a machine-local folder would not
    survive a lost executor, so an unset folder is an error there.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext; the server's setting applies
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            raise RuntimeError("spark.checkpoint.dir must be set on the Spark Connect server") from None
        return current
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: point it at a shared folder (HDFS, object store) "
            "that every executor can reach."
        )
    # spark.checkpoint.dir is a static config: set the context's folder instead.
    local = tempfile.mkdtemp(prefix="replaylab-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


#: Scratch folders made by this process, by session application.
_SCRATCH: list[str] = []


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared checkpoint folder, remembered for :func:`release_scratch`."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders made so far; call it when their frames are no longer used.

    (Checkpoint files go by themselves where the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.)
    """
    done = 0
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return done


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "replaylab", event_log_dir: str | None = None) -> SparkSession:
    """A local[N] session configured like the tests and bench expect.

    ``event_log_dir`` turns on Spark's event log there (stage and task times
    without the UI; summarise with ``tools/stage_times.py``).
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", SESSION_TZ)
        .config("spark.driver.memory", os.environ.get("REPLAYLAB_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if event_log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
