"""Line-oriented files: one file, a folder, or the objects below a prefix."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.session import hadoop_path, log
from linehaul.sources.listing import list_in_tasks, root_of

LINES = "file string, line string"


def s3a_options(
    access_key: str | None = None,
    secret_key: str | None = None,
    connections: int = 5000,
    region: str | None = None,
    endpoint: str | None = None,
) -> dict[str, str]:
    """Reader options for ``s3a://`` paths; keys left out fall back to the cluster's own."""
    options = {
        "fs.s3a.access.key": access_key,
        "fs.s3a.secret.key": secret_key,
        "fs.s3a.connection.maximum": str(connections),
        "fs.s3a.endpoint.region": region,
        "fs.s3a.endpoint": endpoint,
    }
    return {k: v for k, v in options.items() if v is not None}


def object_key(file_path: Column, *roots: str) -> Column:
    """Path of a file relative to the first of the roots (absolute, with or without scheme)
    that it lies below, as an object store lists it; the name of a file that is a root itself.

    Escapes are undone only where there are any, and as nothing but scheme and
    slashes comes before a root, its first place in the URI is the right one.
    """
    unescaped = F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))
    plain = F.when(F.contains(file_path, F.lit("%")), unescaped).otherwise(file_path)
    key = F.substring_index(plain, "/", -1)
    for root in reversed(roots):
        prefix = root.split(":", 1)[-1].strip("/") + "/"
        if prefix == "/":
            key = F.regexp_replace(plain, r"^[^:/]+:/+", "")
            continue
        prefix = "/" + prefix
        at = F.locate(prefix, plain)
        key = F.when(at > 0, F.substr(plain, at + F.lit(len(prefix)))).otherwise(key)
    return key


def full_match(value: str | Column, regex: str) -> Column:
    """True where the regex matches the whole value, not just a part of it."""
    value = F.col(value) if isinstance(value, str) else value
    return value.rlike(rf"\A(?:{regex})\z")


def _paths(path: str | list[str]) -> list[str]:
    """A comma list, as Hadoop takes it, or a list as it is; commas in braces part nothing."""
    return path if isinstance(path, list) else re.split(r",(?![^{]*\})", path)


def _root(spark: SparkSession, path: str) -> str:
    """The folder that keys are relative to: the path up to its first pattern."""
    fixed = re.split(r"[*?\[{]", path, maxsplit=1)
    root = path if len(fixed) == 1 else fixed[0].rsplit("/", 1)[0]
    if root.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root):
        return root
    fs, p = hadoop_path(spark, root or ".")
    return fs.makeQualified(p).toString()


def read_lines(
    spark: SparkSession,
    path: str | list[str],
    key_regex: str | None = None,
    recursive: bool = False,
    options: dict[str, str] | None = None,
    with_file: bool = True,
) -> DataFrame:
    """``(file, line)`` of a file, a folder or, with ``recursive``, all objects below a prefix.

    Patterns and comma lists of paths are taken as Hadoop takes them. ``file``
    is the path relative to ``path`` (the name, for a single file; below a
    pattern, relative to the folder before it).
    ``key_regex`` must match it entirely; the condition only looks at file
    paths, so files that do not match are never opened. A missing path gives a
    warning and no rows. ``with_file=False`` leaves ``file`` out: naming the
    file of every line costs as much as reading the line.
    """
    try:
        lines = (
            spark.read.options(**(options or {}))
            .option("recursiveFileLookup", str(recursive).lower())
            .text(_paths(path))
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("no files in %s", path)
        return spark.createDataFrame([], LINES if with_file else "line string")
    return _with_key(spark, lines, _paths(path), key_regex, with_file)


def _with_key(
    spark: SparkSession,
    lines: DataFrame,
    paths: list[str],
    key_regex: str | None,
    with_file: bool = True,
) -> DataFrame:
    line = F.col("value").alias("line")
    if key_regex is None and not with_file:
        return lines.select(line)
    key = object_key(F.col("_metadata.file_path"), *[_root(spark, p) for p in paths])
    if key_regex is not None:
        lines = lines.filter(full_match(key, key_regex))
    return lines.select(key.alias("file"), line) if with_file else lines.select(line)


def list_files(
    spark: SparkSession,
    path: str | list[str],
    key_regex: str | None = None,
    recursive: bool = False,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """``(file)`` for every file below the path, those without any line included."""
    return list_objects(spark, path, key_regex, recursive, options).select("file")


def list_objects(
    spark: SparkSession,
    path: str | list[str],
    key_regex: str | None = None,
    recursive: bool = False,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """``(file, length)`` of every file below the path.

    Tasks list the folders (see :mod:`linehaul.sources.listing`), so no list of names is held by the driver. Where they can't reach the
    store, or the reader has ``options`` that choose files, Spark's own file index is the
    source, which keeps all names on the driver, and lengths are null.
    """
    paths = _paths(path)
    roots = [root_of(_qualified(spark, p)) for p in paths]
    if all(roots) and not options:
        listed = list_in_tasks(spark, roots, recursive)
    else:
        listed = _indexed(spark, paths, recursive, options)
    key = object_key(F.col("uri"), *[_root(spark, p) for p in paths])
    names = listed.select(key.alias("file"), "length")
    return names if key_regex is None else names.filter(full_match("file", key_regex))


def _qualified(spark: SparkSession, path: str) -> str:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return path
    fixed = re.split(r"[*?\[{]", path, maxsplit=1)[0]
    folder = fixed.rpartition("/")[0] if fixed != path else path
    fs, p = hadoop_path(spark, folder or ("/" if path.startswith("/") else "."))
    rest = path[len(folder) :]
    return fs.makeQualified(p).toString().rstrip("/") + ("" if not rest or rest.startswith("/") else "/") + rest


def _indexed(spark: SparkSession, paths: list[str], recursive: bool, options: dict[str, str] | None) -> DataFrame:
    try:
        listed = (
            spark.read.options(**(options or {}))
            .option("recursiveFileLookup", str(recursive).lower())
            .text(paths)
            .inputFiles()
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        listed = []
    return spark.createDataFrame([(f, None) for f in listed], "uri string, length long")


def read_line_stream(
    spark: SparkSession,
    path: str,
    start: str = "earliest",
    files_per_batch: int | None = None,
    options: dict[str, str] | None = None,
    start_file: str | None = None,
) -> DataFrame:
    """Streaming ``(file, line)`` of a folder that files are dropped into.

    ``start='latest'`` takes only files written after the stream was first set
    up. That moment is kept in ``start_file``, a path next to the checkpoint,
    so that a restart does not move it and files that came meanwhile are read.
    """
    reader = spark.readStream.format("text").options(**(options or {}))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(path)
    if start == "latest":
        if start_file is None:
            raise ValueError("start='latest' needs start_file")
        since = F.timestamp_micros(F.lit(_first_start(spark, start_file)))
        lines = lines.filter(F.col("_metadata.file_modification_time") > since)
    elif start != "earliest":
        raise ValueError("start must be 'earliest' or 'latest'")
    return _with_key(spark, lines, [path], None)


def _first_start(spark: SparkSession, start_file: str) -> int:
    """Microseconds of the first start, written down by it."""
    fs, p = hadoop_path(spark, start_file)
    if not fs.exists(p):
        now = spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("since"))
        now.coalesce(1).write.mode("overwrite").parquet(start_file)
    return spark.read.schema("since long").parquet(start_file).first()[0]
