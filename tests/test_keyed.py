from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from linehaul.operators.keyed import (
    chunk_interval,
    clustered,
    in_time_range,
    latest_by_key,
    retained,
)
from linehaul.operators.relay import relay_messages, replay, union_streams
from linehaul.sinks.tables import write_chunked, write_clustered

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def skewed(spark, n=9000):
    """Rows of which a third has one key; one row per minute."""
    return spark.range(n, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("key"),
        (F.lit(START) + F.expr("make_dt_interval(0, 0, id)")).alias("ts"),
        "id",
    )


def test_latest_by_key(spark):
    df = spark.createDataFrame(
        [(1, "a", 3, "x"), (1, "a", 9, None), (1, "b", 1, "y"), (2, "a", 5, "z")],
        "k int, t string, arrival long, v string",
    )
    got = latest_by_key(df, ["k", "t"], "arrival")
    assert got.columns == df.columns
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, "a", 9, None),
        (1, "b", 1, "y"),
        (2, "a", 5, "z"),
    ]


def test_rows_that_arrived_together_or_at_no_time(spark):
    rows = [(1, "a", None), (1, "b", None), (2, "x", 5), (2, "y", 5), (2, "z", None), (3, "q", 1)]
    df = spark.createDataFrame(rows, "k int, v string, arrival long")
    winners = {
        tuple(sorted(map(tuple, latest_by_key(df.repartition(n, "v"), ["k"], "arrival").collect())))
        for n in (1, 2, 5)
    }
    assert len(winners) == 1
    one, two, three = winners.pop()
    assert one in rows and two in rows[2:4] and three == rows[5]


def test_a_chunked_table_names_its_interval(spark, tmp_path):
    write_chunked(skewed(spark, 600), str(tmp_path / "t"), "ts", 3_600_000_000)
    table = spark.read.parquet(str(tmp_path / "t"))
    assert chunk_interval(table) == 3_600_000_000
    with pytest.raises(ValueError):
        in_time_range(table.select("id", "ts"), "ts", START, START)


def test_latest_by_key_reduces_before_the_shuffle(spark):
    df = latest_by_key(skewed(spark), ["key"], "id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max_by") > plan.index("Exchange")
    assert {r.key: r.id for r in df.collect()}[0] == 8997


def test_clustered_spreads_a_frequent_key_and_keeps_order(spark, tmp_path):
    rows = clustered(skewed(spark), "key", "ts", ["id"], partitions=6)
    got = rows.withColumn("part", F.spark_partition_id()).collect()
    order = [(r.key, -r.ts.timestamp(), r.id) for r in got]
    assert order == sorted(order) and len(got) == 9000
    assert [r.part for r in got] == sorted(r.part for r in got)
    hot = {r.part for r in got if r.key == 0}
    assert len(hot) > 1
    write_clustered(skewed(spark), str(tmp_path / "t"), "key", "ts", ["id"], partitions=6)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 9000


def test_clustered_spreads_a_key_whose_times_are_all_equal(spark):
    rows = skewed(spark).withColumn("ts", F.lit(START))
    parts = clustered(rows, "key", "ts", partitions=6).withColumn("p", F.spark_partition_id())
    hot = parts.filter("key = 0").groupBy("p").count().collect()
    assert len(hot) > 1 and sum(r["count"] for r in hot) == rows.filter("key = 0").count()


def test_chunks_are_written_apart_and_skipped_on_read(spark, tmp_path):
    path, hour = str(tmp_path / "t"), 3_600_000_000
    write_chunked(skewed(spark, 600), path, "ts", hour)
    table = spark.read.parquet(path)
    assert table.select(f"chunk_{hour}").distinct().count() == 10
    since, until = START + timedelta(hours=2, minutes=30), START + timedelta(hours=4)
    part = in_time_range(table, "ts", since, until)
    assert sorted(r.id for r in part.collect()) == list(range(150, 240))
    plan = part._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    assert scan.metrics().apply("numPartitions").value() == 3


def test_a_chunk_with_most_rows_is_split_over_tasks(spark, tmp_path):
    rows = spark.range(200_000, numPartitions=8).select(
        F.lit(START).alias("ts"), "id", F.sha2(F.col("id").cast("string"), 256).alias("text")
    )
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        write_chunked(rows, str(tmp_path / "t"), "ts")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.count() == 200_000
    assert len(table.inputFiles()) > 2


def test_retained(spark):
    rows = skewed(spark, 600)
    as_of = START + timedelta(minutes=599)
    assert retained(rows, "ts", as_of, 60).count() == 1
    assert retained(rows, "ts", as_of, 3600).count() == 60
    assert retained(rows, "ts", as_of, -1).count() == 600


def test_replay_relay_union(spark):
    lines = spark.createDataFrame([("a",), ("b",)], "line string")
    got = replay(lines, 3).collect()
    assert sorted(r.value for r in got) == ["a"] * 3 + ["b"] * 3
    assert len({r.key for r in got}) == 6
    assert replay(lines, 0).count() == 0 and replay(lines, 1).count() == 2
    with pytest.raises(ValueError):
        replay(lines, -1)
    plan = replay(lines, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "CartesianProduct" not in plan

    messages = spark.createDataFrame([(1, "x", None), (2, None, 0)], "key int, value string, p int")
    assert [tuple(r) for r in relay_messages(messages).collect()] == [("1", "x"), ("2", None)]

    other = spark.createDataFrame([("b", 1), ("a", 1)], "line string, n int").select("n", "line")
    first = lines.withColumn("n", F.lit(1))
    both = union_streams([first, other, first])
    assert sorted(r.line for r in both.collect()) == ["a", "a", "a", "b", "b", "b"]
