"""Staged tables and fixed-size bit sets, shared by the operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.session import hadoop_path, new_work_folder

#: Rows of one Arrow batch handed to Python; bounds what a task holds with long texts.
BATCH_ROWS = 256

#: The folder that holds the package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

_written: list[str] = []


def small_batches(spark: SparkSession) -> SparkSession:
    """Hand texts to Python in batches of few rows, whatever their length.

    Python workers find the package where the driver found it, as in a checkout that is
    not installed.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, ROOT]))
    return spark


def staged(df: DataFrame, purpose: str, compression: str = "snappy") -> DataFrame:
    """Write a frame to the shared work folder and read it back, which cuts its lineage.

    The table stays until :func:`release`, since a returned frame may read it at any time.
    """
    spark = small_batches(df.sparkSession)
    path = new_work_folder(spark, purpose)
    df.write.parquet(path, compression=compression)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a staged table before the end: all that reads it has been written out."""
    spark = df.sparkSession
    root = df.inputFiles()
    for path in [p for p in _written if any(f"/{p.rpartition('/')[2]}/" in f for f in root[:1])]:
        _written.remove(path)
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """Remove the tables staged so far; frames that read them must have been written out."""
    while _written:
        fs, path = hadoop_path(spark, _written.pop())
        fs.delete(path, True)


def keyed(docs: DataFrame, id_col: str, *others: str) -> DataFrame:
    """``(id, …)`` of the named columns only, so that extra columns can't clash."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("id"), *[docs[c].alias(c) for c in others])


def bit_set(df: DataFrame, value: Column, bits: int) -> bytes:
    """A bit set of ``2 ** bits`` bits with bit ``value mod 2 ** bits`` set for every row.

    Built by Spark's bitmap aggregates, 4 KB a block; the driver gets ``2 ** bits / 8``
    bytes at most, however many rows there are.
    """
    block = 32768
    cell = F.pmod(value, F.lit(2**bits))
    rows = (
        df.select(cell.alias("c"))
        .groupBy(F.floor(F.col("c") / block).alias("b"))
        .agg(F.bitmap_construct_agg((F.col("c") % block).cast("long")).alias("m"))
    )
    out = bytearray(max(2**bits, block) // 8)
    for r in rows.toLocalIterator():
        out[r["b"] * block // 8 : r["b"] * block // 8 + len(r["m"])] = r["m"]
    return bytes(out)
