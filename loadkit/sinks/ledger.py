"""Small files that decide: create-if-absent entries beside a table.

An entry is a file that exactly one writer can create, with its whole content
or not at all.  On a local or mounted file system it is a hard link to a
finished temporary file; elsewhere a rename that refuses an existing target,
which is atomic on HDFS.  Object stores without such a rename are safe for
one writer at a time only.

Folders of entries begin with an underscore, so readers of the table skip
them.  They are read by the driver: one entry a batch or key range, never a
row of data.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from loadkit.session import local_path


def _file_system(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def _is_local(spark: SparkSession, path: str) -> bool:
    fs, _ = _file_system(spark, path)
    return fs.getUri().getScheme() == "file"


def create_entry(spark: SparkSession, path: str, content: dict) -> bool:
    """Create ``path`` with ``content``; False if it exists already."""
    text = json.dumps(content, sort_keys=True)
    folder, name = path.rsplit("/", 1)
    if _is_local(spark, path):
        own = local_path(folder)
        os.makedirs(own, exist_ok=True)
        part = os.path.join(own, f".{name}-{uuid.uuid4().hex}")
        with open(part, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(part, os.path.join(own, name))
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        return True
    jvm = spark.sparkContext._jvm
    fs, target = _file_system(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        return bool(not fs.exists(target) and fs.rename(part, target))
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    finally:
        if fs.exists(part):
            fs.delete(part, False)


def read_entry(spark: SparkSession, path: str) -> dict | None:
    """The content of the entry ``path``; None if there is none."""
    if _is_local(spark, path):
        try:
            with open(local_path(path), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None
    fs, hpath = _file_system(spark, path)
    if not fs.exists(hpath):
        return None
    jvm = spark.sparkContext._jvm
    stream = fs.open(hpath)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def entry_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries in ``folder``, in order."""
    if _is_local(spark, folder):
        own = local_path(folder)
        return sorted(n for n in os.listdir(own) if not n.startswith(".")) if os.path.isdir(own) else []
    fs, hpath = _file_system(spark, folder)
    if not fs.exists(hpath):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(hpath))
    return sorted(n for n in names if not n.startswith("."))


def key_name(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()[:32]


def take_number(spark: SparkSession, folder: str, key: str) -> int:
    """The number of ``key``: the one it has, else the next free one, which no other key can get.

    A writer that dies between the two entries leaves a number unused.
    """
    mine = f"{folder}/by_key/{key_name(key)}"
    while (known := read_entry(spark, mine)) is None:
        taken = entry_names(spark, f"{folder}/numbers")
        number = int(taken[-1]) + 1 if taken else 0
        if create_entry(spark, f"{folder}/numbers/{number:018d}", {"key": key}):
            create_entry(spark, mine, {"key": key, "number": number})
    return int(known["number"])


def reserve_range(spark: SparkSession, folder: str, key: str, count: int, first: int) -> int:
    """The first of ``count`` consecutive numbers that only ``key`` has; ranges follow each other from ``first`` on.

    The same key and count get the same range again.  Two that reserve at
    once try to create the same entry; the loser goes on behind the winner.
    """
    mine = f"{folder}/by_key/{key_name(f'{key}:{count}')}"
    while (known := read_entry(spark, mine)) is None:
        taken = entry_names(spark, f"{folder}/ranges")
        start = first
        if taken:
            start = int(read_entry(spark, f"{folder}/ranges/{taken[-1]}")["end"])
        content = {"key": key, "start": start, "end": start + count}
        if create_entry(spark, f"{folder}/ranges/{start:018d}", content):
            create_entry(spark, mine, content)
    return int(known["start"])
