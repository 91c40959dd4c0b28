"""Listing files in tasks: a table of keys and lengths that never passes through the driver.

Folders are listed level by level. Every round deals the folders out to tasks, writes what they hold and goes
on with the folders among it, so many prefixes are listed at a time and a store of any number of objects
costs as many rounds as it has levels. A task lists one folder at a time.

The tasks use Arrow's file systems (local files, ``s3`` and ``s3a``, ``gs``, ``hdfs`` where its library is
installed). Schemes that Arrow does not know have to be listed by Spark's own index.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.session import new_work_folder

_LISTED = "root int, uri string, path string, folder boolean, length long"
#: Names of a scheme that Arrow calls by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


@dataclass(frozen=True)
class Root:
    """Where a listing starts: a file, a folder or the folder before a pattern."""

    scheme: str
    #: Path in Arrow's file system, without a pattern.
    start: str
    #: One regex per path segment of the pattern; none for a plain path.
    pattern: tuple[str, ...] = ()

    def depth(self, path: str) -> int:
        """Segments below the start."""
        return len([s for s in path[len(self.start) :].split("/") if s])

    def leads(self, path: str) -> bool:
        """Whether a path fits the pattern as far as it goes."""
        names = [s for s in path[len(self.start) :].split("/") if s]
        return all(re.fullmatch(p, n) for p, n in zip(self.pattern, names))


def _segments(pattern: str) -> list[str]:
    """A Hadoop pattern (``*``, ``?``, ``[…]``, ``{a,b}``) as one regex per segment."""
    out, depth, at = [""], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "[":
            end = pattern.index("]", at + 2)
            out[-1] += "[" + pattern[at + 1 : end].replace("!", "^", 1 if pattern[at + 1] == "!" else 0) + "]"
            at = end
        elif c == "\\" and at + 1 < len(pattern):
            at += 1
            out[-1] += re.escape(pattern[at])
        elif c == "/" and not depth:
            out.append("")
        else:
            depth += (c == "{") - (c == "}")
            marks = {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}
            out[-1] += marks.get(c) or ("|" if c == "," and depth else re.escape(c))
        at += 1
    return [s for s in out if s]


def root_of(uri: str) -> Root | None:
    """The start of a qualified path, or None where Arrow can't list its scheme or a brace spans folders."""
    scheme, _, rest = uri.partition(":")
    fixed = re.split(r"[*?\[{]", rest, maxsplit=1)[0]
    start = (rest if fixed == rest else fixed.rpartition("/")[0]).rstrip("/")
    if "/" in "".join(re.findall(r"\{[^}]*\}", rest)):
        return None
    name = _SCHEMES.get(scheme, scheme)
    try:
        system, path = fs.FileSystem.from_uri(f"{name}://{quote('/' + start.lstrip('/') if name == 'file' else start.lstrip('/'))}")
    except (ValueError, OSError, NotImplementedError, pa.ArrowException):
        return None
    return Root(name if name == scheme else f"{scheme}>{name}", path.rstrip("/"), tuple(_segments(rest[len(start) :])))


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _levels(roots: list[Root], recursive: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    systems: dict[str, fs.FileSystem] = {}

    def system(root: Root) -> fs.FileSystem:
        name = root.scheme.rpartition(">")[2]
        if name not in systems:
            host = root.start.split("/")[0] if name != "file" else ""
            systems[name] = fs.FileSystem.from_uri(f"{name}://{host or '/'}")[0]
        return systems[name]

    def wanted(root: Root, info: fs.FileInfo) -> bool:
        depth, n = root.depth(info.path), len(root.pattern)
        folder = info.type == fs.FileType.Directory
        if not root.leads(info.path) or (_hidden(info.base_name) and not (folder and depth <= n)):
            return False
        if folder:
            # Without recursion only folders that name a column's value are gone into.
            return depth <= n or recursive or "=" in info.base_name
        return depth >= n

    def inside(root: Root, path: str) -> list[fs.FileInfo]:
        files = system(root)
        found = files.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            return []
        if found.type == fs.FileType.File:
            return [] if root.pattern or _hidden(found.base_name) else [found]
        listed = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return [i for i in listed if wanted(root, i)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path in zip(batch["root"].to_pylist(), batch["path"].to_pylist()):
                root = roots[number]
                found = inside(root, path)
                scheme = root.scheme.partition(">")[0]
                yield pa.record_batch(
                    {
                        "root": pa.array([number] * len(found), pa.int32()),
                        "uri": pa.array([f"{scheme}://{quote(i.path)}" for i in found], pa.string()),
                        "path": pa.array([i.path for i in found], pa.string()),
                        "folder": pa.array([i.type == fs.FileType.Directory for i in found], pa.bool_()),
                        "length": pa.array([i.size or 0 for i in found], pa.int64()),
                    }
                )

    return run


def list_in_tasks(spark: SparkSession, roots: list[Root], recursive: bool) -> DataFrame:
    """``(uri, length)`` of every file below the roots, those of no length included."""
    run, found = _levels(roots, recursive), []
    folders = spark.createDataFrame([(k, r.start or "/") for k, r in enumerate(roots)], "root int, path string")
    while True:
        # A row is a folder's whole listing: one a batch keeps a task's memory at that.
        path = new_work_folder(spark, "listing")
        folders.repartition("root", "path").mapInArrow(run, _LISTED).write.parquet(path)
        level = spark.read.schema(_LISTED).parquet(path)
        found.append(level.where("not folder").select("uri", "length"))
        folders = level.where("folder").select("root", "path")
        if folders.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.distinct() if len(roots) > 1 else every
