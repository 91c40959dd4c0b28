"""Results under tasks whose first attempt is lost: ``python tests/retry_check.py WORK_FOLDER``.

A program of its own, since the number of task attempts is fixed when a session starts.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from linehaul.functions import with_objectid  # noqa: E402
from linehaul.operators import latest_by_key  # noqa: E402
from linehaul.sinks import write_chunked, write_clustered  # noqa: E402

N = 60_000
HOUR_US = 3_600_000_000


@F.udf(LongType())
def lost_once(x):
    task = TaskContext.get()
    if task.attemptNumber() == 0 and task.partitionId() % 2 and x % 5000 == 4999:
        raise RuntimeError("lost")
    return x


if __name__ == "__main__":
    work = sys.argv[1]
    spark = (
        SparkSession.builder.master("local[4,4]")
        .config("spark.sql.shuffle.partitions", "6")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", work)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    rows = spark.range(N, numPartitions=6).select(
        lost_once("id").alias("k"), (F.col("id") % 7).alias("g")
    )
    for order in (None, ["k"], ["g"]):
        got = with_objectid(rows, order).collect()
        assert sorted(r.objectid for r in got) == list(range(1, N + 1))
        assert len({r.k for r in got}) == N
    write_clustered(rows, f"{work}/clustered", "g", "k")
    assert spark.read.parquet(f"{work}/clustered").distinct().count() == N
    write_chunked(rows.withColumn("ts", F.timestamp_seconds("k")), f"{work}/chunked", "ts", HOUR_US)
    chunked = spark.read.parquet(f"{work}/chunked")
    assert chunked.count() == chunked.select("k").distinct().count() == N
    assert latest_by_key(rows, ["g"], "k").count() == 7
    print("all rows once")
