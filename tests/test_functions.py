from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from linehaul.functions import (
    chunk_number,
    ewkt_point,
    first_of_list,
    format_epoch_ms,
    geo_array,
    point_struct,
    split_lines,
    split_list,
    stable_uuid,
    with_objectid,
    with_uuid,
    wkt_point,
)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


def test_points(spark):
    p = {"lon": "-1.50", "lat": "2"}
    assert one(spark, wkt_point("lon", "lat"), **p) == "POINT (-1.50 2)"
    assert one(spark, ewkt_point("lon", "lat"), **p) == "SRID=4326;POINT (-1.50 2)"
    n = {"lon": -1.5, "lat": 2.0}
    assert one(spark, geo_array("lon", "lat"), **n) == [-1.5, 2.0]
    assert one(spark, point_struct("lon", "lat"), **n).asDict() == n


def test_first_of_list(spark):
    many = "n7,n3,n11,n2,n9,n1"
    for text, want in [(many, "n7"), ("n7", "n7"), (",b", ""), ("", "")]:
        assert one(spark, first_of_list("s"), s=text) == want


def test_split_list(spark):
    cases = {
        "a,b,c": ["a", "b", "c"],
        "a": ["a"],
        "": [""],
        ",a": ["", "a"],
        "a,,b": ["a", "", "b"],
        "a,b,,": ["a", "b"],
        ",": [],
        ",,,": [],
        "a,\n": ["a", "\n"],
    }
    for text, want in cases.items():
        assert one(spark, split_list("s"), s=text) == want, text


def test_split_lines_cuts_like_a_file_reader(spark, tmp_path):
    cases = ["", "\n", "a", "a\n", "a\n\n", "a\r\nb\rc\n", "\r\n\r\n", "a\n\r", "\na", "x\r"]
    for i, text in enumerate(cases):
        path = tmp_path / f"{i}.txt"
        path.write_bytes(text.encode())
        want = [r.value for r in spark.read.text(str(path)).collect()]
        assert one(spark, split_lines("s"), s=text) == want, repr(text)


def test_format_and_chunks(spark):
    assert one(spark, format_epoch_ms("ms"), ms=1533036645250) == "2018-07-31 11:30:45.250"
    assert one(spark, format_epoch_ms("ms"), ms=0) == "1970-01-01 00:00:00.000"
    df = spark.createDataFrame([(-1,), (0,), (59_999_999,), (60_000_000,)], "us bigint")
    got = df.select(chunk_number(F.timestamp_micros("us"), 60_000_000).alias("c"))
    assert [r.c for r in got.collect()] == [-1, 0, 0, 1]
    with pytest.raises(ValueError):
        chunk_number("ts", 0)
    when = one(spark, chunk_number("ts"), ts=datetime(2024, 1, 4, 0, 0))
    assert when == 1704326400 // (7 * 86400)


def test_ids_by_row(spark):
    df = with_uuid(spark.range(1000), "u").select("u", stable_uuid("id").alias("s"))
    got = df.collect()
    assert len({r.u for r in got}) == len({r.s for r in got}) == 1000
    assert all(len(r.s) == 36 and r.s.count("-") == 4 for r in got)
    again = spark.range(1000).select(stable_uuid("id").alias("s")).collect()
    assert {r.s for r in got} == {r.s for r in again}
    pairs = spark.createDataFrame([("a", "b,c"), ("a,b", "c"), ("a", None)], "x string, y string")
    assert pairs.select(stable_uuid("x", "y").alias("s")).distinct().count() == 3


def test_objectids_are_dense_and_in_order(spark):
    rows = spark.range(10_000, numPartitions=7).select(((F.col("id") * 7919) % 10_007).alias("k"))
    got = with_objectid(rows, ["k"]).collect()
    assert [r.objectid for r in sorted(got, key=lambda r: r.k)] == list(range(1, 10_001))


def test_objectids_without_order_and_with_empty_partitions(spark):
    rows = spark.range(5000, numPartitions=9).filter("id % 1000 < 300 and id > 1200")
    n = rows.count()
    got = with_objectid(rows, start=100)
    assert sorted(r.objectid for r in got.collect()) == list(range(100, 100 + n))
    assert with_objectid(rows.filter("id < 0")).count() == 0


def test_objectids_with_one_very_frequent_key(spark):
    rows = spark.range(9000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id"
    )
    got = with_objectid(rows, ["k", "id"]).collect()
    assert [r.objectid for r in sorted(got, key=lambda r: (r.k, r.id))] == list(range(1, 9001))


def test_a_frequent_key_spreads_without_a_unique_order(spark):
    rows = spark.range(40_000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id"
    )
    got = with_objectid(rows, ["k"])
    ids = got.orderBy("objectid").collect()
    assert [r.objectid for r in ids] == list(range(1, 40_001))
    assert [r.k for r in ids] == sorted(r.k for r in ids)


def test_rows_with_nested_maps_and_odd_names(spark):
    df = spark.sql(
        "SELECT id % 3 AS g, array(map('a', id)) AS `odd ``name`, struct(parse_json('[1]') AS v, id) AS s FROM range(50)"
    )
    got = with_objectid(df, ["g"]).select("g", "objectid").collect()
    assert sorted(r.objectid for r in got) == list(range(1, 51))
    assert [r.g for r in sorted(got, key=lambda r: r.objectid)] == sorted(r.g for r in got)
    only_maps = df.select(F.col("`odd ``name`").alias("m"))
    assert with_objectid(only_maps, [F.size("m")]).count() == 50


def test_unordered_numbering_does_not_shuffle_rows(spark):
    plan = with_objectid(spark.range(100))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert "BroadcastHashJoin" in plan
