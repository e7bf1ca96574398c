"""Spark session helpers.

The library never hard-codes cluster paths. Anything that must outlive a task
(checkpoints, written tables) goes under ``spark.checkpoint.dir`` as set by the
cluster; only in a local session without that setting (tests) do we pick a
scratch folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter for this workload: rows are whole documents, so Arrow
# batches must stay small; AQE coalesces the small post-shuffle partitions and
# splits skewed ones. They apply only where the session does not say otherwise.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.session.timeZone": "UTC",
}
#: Caller's setting: read the page table in this many partitions (a shuffle of the html). Unset: as the files are.
INPUT_PARTITIONS = "pagemill.inputPartitions"


def get_session(master: str | None = None, app: str = "pagemill",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """A session with the library's defaults; ``extra`` and the cluster's own settings win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(extra or {})
    if shuffle_partitions:
        conf.setdefault("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    given = {k for k, _ in spark.sparkContext.getConf().getAll()} | set(conf)
    for k, v in DEFAULT_CONF.items():
        if k not in given:
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: Rows of a batch that a Python step takes.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Give a session that does not say how many rows a Python step takes at a time the library's default.

    Spark's own default is 10,000. With rows that are whole documents the JVM and
    the worker each hold several times that many texts, and a worker keeps the
    memory for as long as it lives.
    """
    if spark.conf.get(BATCH_ROWS, None) is None:
        spark.conf.set(BATCH_ROWS, DEFAULT_CONF[BATCH_ROWS])


#: How a stream writes the files of its checkpoint folder, state included.
FILE_MANAGER = "spark.sql.streaming.checkpointFileManagerClass"
PLAIN_FILES = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"


@contextmanager
def plain_files(spark: SparkSession, path: str) -> Iterator[None]:
    """A stream started herein, with its checkpoint at ``path``, writes its files there by Hadoop's FileSystem.

    On a mounted file system Spark's own choice, FileContext, was measured at two to
    three times the wall time of the state's tasks, most of it waiting: each state
    partition and trigger writes the files of several stores. Other stores, and a
    session that names a manager, keep theirs; the session is as before afterwards.
    """
    store = _place(spark, path)[1]
    if store.getUri().getScheme() != "file" or spark.conf.get(FILE_MANAGER, None) is not None:
        yield
        return
    spark.conf.set(FILE_MANAGER, PLAIN_FILES)
    try:
        yield
    finally:
        spark.conf.unset(FILE_MANAGER)


_LOCAL_DIRS: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, from ``spark.checkpoint.dir``.

    On a cluster it must be set: a folder of one machine would not do, so its
    absence is an error. Local sessions without it (tests) get a scratch folder.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = sc.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="pagemill-ckpt-")
        d = _LOCAL_DIRS[app]
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), "tables", name)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def child_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in whatever store it is; none if it is not there."""
    place, store = _place(spark, path)
    return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path, in whatever store it is, is a folder and not a file."""
    place, store = _place(spark, path)
    return store.getFileStatus(place).isDirectory()


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, in whatever store it is."""
    place, store = _place(spark, path)
    store.delete(place, True)


def reliable_checkpoint(df):
    """Cut lineage by writing ``df`` under the shared checkpoint folder.

    Unlike a local checkpoint this survives executor loss: the data lives in
    the shared folder, not on the executors' disks.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
