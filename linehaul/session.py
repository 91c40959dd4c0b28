"""Session settings the package relies on, and the shared work folder."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

log = logging.getLogger("linehaul")

_local_root: str | None = None
_scope: ContextVar[list[str] | None] = ContextVar("linehaul_work_scope", default=None)


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone, so that formatted times do not depend on the machine."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which every executor can reach.

    A machine-local folder is made only for a local master; on a cluster a
    missing setting is an error, since staged rows must outlive any executor.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="linehaul-")
    return _local_root


def new_work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path (not yet created) below the work root."""
    path = f"{work_root(spark)}/linehaul/{purpose}-{uuid.uuid4().hex}"
    made = _scope.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the work folders made inside the block when it ends.

    Frames that read staged rows must be written out before that. Without a
    scope the folders stay, since a returned frame may be read at any time.
    """
    token = _scope.set([])
    try:
        yield
    finally:
        made = _scope.get()
        _scope.reset(token)
        for path in made:
            fs, p = hadoop_path(spark, path)
            fs.delete(p, True)


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of the Hadoop API for a path of any scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place without a job: written beside, then renamed over what is there."""
    folder, _, name = path.rpartition("/")
    fs, beside = hadoop_path(spark, f"{folder}/.{name}.new")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    _, p = hadoop_path(spark, path)
    fs.delete(p, False)
    move(spark, beside.toString(), path)


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, p = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, p = hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder in one step; the folder above the target is made."""
    fs, p = hadoop_path(spark, target)
    _, old = hadoop_path(spark, source)
    if fs.exists(old):
        fs.mkdirs(p.getParent())
    if not (fs.exists(old) and fs.rename(old, p)):
        raise OSError(f"{source} can't be moved to {target}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)
