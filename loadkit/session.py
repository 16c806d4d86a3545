"""Session construction and the shared folder used for staging and checkpoints.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` (or an
earlier ``setCheckpointDir``) names.  Only when neither is set and the master
is ``local`` do we create one ourselves.

Loads leave their staged tables under ``<shared folder>/loadkit``; each load
returns the paths (``LoadResult.staged``).  They must stay as long as a frame
read from them is in use and can be deleted after the load has returned.
"""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections import Counter
from contextlib import contextmanager

from pyspark.sql import DataFrameWriter, SparkSession


def build_session(app: str = "loadkit", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session with the settings every load here assumes.

    AQE stays on (runtime coalescing, skew-join splitting, broadcast
    conversion); the UI is off; the session time zone is UTC so
    timestamp values are the same on every host.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for checkpoints and staged tables.

    Read from the session.  A session without one gets a folder of its own
    only when everything runs in this process (``local``); on a cluster other
    nodes could not see that folder, so there the setting is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        conf_dir = tempfile.mkdtemp(prefix="loadkit-shared-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never-reused path under the shared folder."""
    return f"{shared_dir(spark)}/loadkit/{label}-{uuid.uuid4().hex[:12]}"


#: Parquet codec of written tables, unless the session names one: about 30% smaller than Spark's default.
CODEC, CODEC_SETTING = "zstd", "spark.sql.parquet.compression.codec"


def compressed(spark: SparkSession, writer: DataFrameWriter) -> DataFrameWriter:
    """``writer`` of Parquet files with ``CODEC``; a session that sets a codec keeps its own."""
    return writer if spark.conf.get(CODEC_SETTING, None) else writer.option("compression", CODEC)


OPEN_FILES, OPEN_SETTING = 4, "spark.sql.maxConcurrentOutputFileWriters"
_open_lock, _open_users, _open_before = threading.Lock(), Counter(), {}


@contextmanager
def files_side_by_side(spark: SparkSession):
    """Writes partitioned by a column of few values keep a file open for each, in place of sorting their rows by it.

    A session's setting: the first of several writes at once sets it, the last puts back what was there.
    """
    with _open_lock:
        if not _open_users[spark]:
            _open_before[spark] = spark.conf.get(OPEN_SETTING, None)
            spark.conf.set(OPEN_SETTING, max(OPEN_FILES, int(_open_before[spark] or 0)))
        _open_users[spark] += 1
    try:
        yield
    finally:
        with _open_lock:
            _open_users[spark] -= 1
            if not _open_users[spark]:
                del _open_users[spark]
                before = _open_before.pop(spark)
                spark.conf.unset(OPEN_SETTING) if before is None else spark.conf.set(OPEN_SETTING, before)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, on whatever filesystem its scheme names.

    Asking the filesystem avoids issuing a read that fails, which the
    session's query listeners would report as an error.
    """
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so Python can open a local path (tests only)."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)
