"""Row ids: random, repeatable and sequential."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linehaul.session import new_work_folder

# Write tasks per block of the offsets: sums run within blocks, and over blocks in one pass.
_BLOCK = 4096
_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, row below


def with_uuid(df: DataFrame, name: str = "globalid") -> DataFrame:
    """A random id per row. Add it last, right before the write: it is drawn anew per run."""
    return df.withColumn(name, F.expr("uuid()"))


def stable_uuid(*columns: str | Column) -> Column:
    """An id of the same form computed from the columns (topic, partition, offset, say).

    A retried batch gets the same ids, so a keyed target sees no duplicates.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    # to_json keeps field borders and nulls apart, which plain concatenation would not.
    digest = F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts])


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row: the last sort key that tells rows of equal keys apart.

    It depends on nothing but the row, so a repeated task puts every row where
    it was before.
    """
    parts = []
    for f in df.schema:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        parts.append(c if _hashable(f.dataType) else F.to_json(F.struct(c.alias("c"))))
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")


def _hashable(kind: T.DataType) -> bool:
    """Whether Spark's hash takes the type; maps and variants have no hash at any depth."""
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def with_objectid(
    df: DataFrame,
    order_by: list[str | Column] | None = None,
    start: int = 1,
    name: str = "objectid",
) -> DataFrame:
    """Add ``start, start + 1, …`` with no gap and no repeat over the whole input.

    The rows are written once to the work folder together with the number of
    the task that wrote them and their place in it; a count per task gives each
    task its offset. Without ``order_by`` nothing is shuffled. With it, rows are
    range-partitioned and sorted in parallel. Equal keys are put in the order of
    a hash of their rows, which also lets a very frequent key spread over tasks.
    Select the columns you need before: all of them are staged.
    """
    return numbered_rows(df, order_by, start, name)[0]


def numbered_rows(
    df: DataFrame,
    order_by: list[str | Column] | None = None,
    start: int = 1,
    name: str = "objectid",
) -> tuple[DataFrame, Callable[[], int]]:
    """What :func:`with_objectid` gives, and what tells the number of its rows."""
    spark = df.sparkSession
    if order_by:
        df = df.orderBy(*order_by, row_hash(df))
    place = F.monotonically_increasing_id()
    numbered = df.select(
        "*",
        F.shiftright(place, _POSITION_BITS).cast("int").alias("_task"),
        place.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_place"),
    )
    staged = new_work_folder(spark, "objectid")
    numbered.write.parquet(staged)
    rows = spark.read.schema(numbered.schema).parquet(staged)

    place = F.col("_place") + F.lit(start)
    counts = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    few = sorted(counts.limit(_BLOCK + 1).collect())
    if len(few) <= _BLOCK:
        # Offsets of a few tasks are a short list in the plan itself.
        before = [0, *accumulate(n for _, n in few)]
        listed = ", ".join(f"({task}, {at}L)" for (task, _), at in zip(few or [(0, 0)], before))
        offsets = spark.sql(f"SELECT * FROM VALUES {listed} AS t(_task, _before)")
        out = rows.join(F.broadcast(offsets), "_task").withColumn(name, F.col("_before") + place)
        return out.drop("_task", "_place", "_before"), lambda: before[-1]

    # One row per write task; written, so that Spark knows its size: it is broadcast below
    # the session's threshold and joined by a shuffle beyond.
    counts = counts.withColumn("_block", F.expr(f"_task div {_BLOCK}"))
    earlier = Window.unboundedPreceding, -1
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_n"))
    blocks = blocks.select(
        "_block", F.sum("_n").over(Window.orderBy("_block").rowsBetween(*earlier)).alias("_blocks")
    )
    inside = Window.partitionBy("_block").orderBy("_task").rowsBetween(*earlier)
    offsets = (
        counts.withColumn("_inside", F.sum("_n").over(inside))
        .join(blocks, "_block")
        .select(
            "_task",
            "_n",
            (F.coalesce("_blocks", F.lit(0)) + F.coalesce("_inside", F.lit(0))).alias("_before"),
        )
    )
    placed = new_work_folder(spark, "offsets")
    offsets.write.parquet(placed)
    offsets = spark.read.schema(offsets.schema).parquet(placed)
    out = (
        rows.join(offsets.drop("_n"), "_task")
        .withColumn(name, F.col("_before") + place)
        .drop("_task", "_place", "_before")
    )
    return out, lambda: offsets.agg(F.sum("_n")).first()[0]
