from __future__ import annotations

import pytest
import standins
from conftest import LINE1, LINE2
from pyspark.sql import functions as F

from linehaul import schemas as S
from linehaul.operators.feed import good_rows, parse_feed, to_documents, to_planes12
from linehaul.session import new_work_folder, work_root
from linehaul.sinks import (
    append,
    cassandra,
    conform,
    elasticsearch,
    files,
    postgres,
    read_keyed,
    recreate,
    topic,
    write,
    write_batch_once,
)

from linehaul.sinks.targets import Target


@pytest.fixture()
def rows(feed):
    return to_planes12(good_rows(parse_feed(feed(LINE1, LINE2), id_type="bigint")))


def test_recreate_and_append(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    append(rows, path)
    recreate(spark, path, S.planes12())
    assert spark.read.parquet(path).count() == 0
    assert spark.read.parquet(path).columns == S.planes12().names
    append(rows, path, S.planes12())
    append(rows, path, S.planes12())
    assert spark.read.parquet(path).count() == 4
    append(rows, path, S.planes12(), recreate_first=True)
    assert spark.read.parquet(path).count() == 2


def test_recreate_replaces_all_partitions_in_either_mode(spark, tmp_path):
    path, mode = str(tmp_path / "t"), "spark.sql.sources.partitionOverwriteMode"
    rows = spark.range(10).withColumn("p", F.col("id") % 5)
    old = spark.conf.get(mode)
    try:
        for kind in ("static", "dynamic"):
            spark.conf.set(mode, kind)
            append(rows, path, partition_by=["p"], recreate_first=True)
            append(rows.filter("p = 1"), path, partition_by=["p"], recreate_first=True)
            assert spark.read.parquet(path).count() == 2
    finally:
        spark.conf.set(mode, old)


def test_writer_tasks_do_not_narrow_the_work(spark, tmp_path):
    target = Target("parquet", path=str(tmp_path / "t"), tasks=2)
    write(spark.range(1000, numPartitions=6), target)
    read = spark.read.parquet(str(tmp_path / "t"))
    assert read.count() == 1000 and len(read.inputFiles()) == 2


def test_conform_goes_by_name(spark, rows):
    mixed = rows.select(*reversed(rows.columns), F.lit(1).alias("more"))
    got = conform(mixed, S.planes12())
    assert got.columns == S.planes12().names
    assert sorted(r.lon for r in got.collect()) == [-12.53175, 151.207345120984]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch_id, n in [(0, 5), (1, 7), (1, 7)]:
        write_batch_once(spark.range(n), batch_id, path)
    assert spark.read.parquet(path).count() == 12


def test_a_later_row_hides_the_earlier_one_of_its_key(spark, tmp_path):
    path = str(tmp_path / "t")
    columns = "id int, ts int, v string, offset int"
    first = [(1, 10, "a", 0), (1, 20, "b", 1), (2, 10, "c", 2), (1, 10, "d", 3)]
    write_batch_once(spark.createDataFrame(first, columns), 0, path)
    write_batch_once(spark.createDataFrame([(2, 10, "e", 0), (3, 10, "f", 1)], columns), 1, path)
    got = read_keyed(spark, path, ["id", "ts"], F.struct("batch_id", "offset"))
    assert sorted((r.id, r.ts, r.v) for r in got.collect()) == [
        (1, 10, "d"), (1, 20, "b"), (2, 10, "e"), (3, 10, "f"),
    ]


def test_document_files(spark, feed, tmp_path):
    good = good_rows(parse_feed(feed(LINE1, LINE2), hashes=True)).withColumn("objectid", F.lit(1))
    write(to_documents(good, as_text=False), files(str(tmp_path / "json")))
    read = spark.read.schema(S.document(True)).json(str(tmp_path / "json"))
    assert sorted(r.square for r in read.collect()) == ["BBB", "CADBDDACBBADCDBACBADDBCACDBAAC"]
    write(to_documents(good), files(str(tmp_path / "text"), "text"))
    assert spark.read.json(str(tmp_path / "text")).count() == 2
    copy = spark.read.text(str(tmp_path / "text")).withColumnRenamed("value", "document")
    write(copy, files(str(tmp_path / "copy"), "text"))
    assert spark.read.json(str(tmp_path / "copy")).count() == 2


def test_table_rows_reach_the_keyed_store(spark, rows, tmp_path):
    target = cassandra("realtime", "planes", host="h", consistency="ONE", ttl_seconds=60)
    spark.dataSource.register(standins.sink(target.fmt, str(tmp_path)))
    write(rows, target)
    got, options = standins.written(tmp_path)
    assert sorted((r["id"], r["lon"], r["lat"]) for r in got) == [
        (0, -12.53175, 38.40721),
        (1, 151.207345120984, -33.868901745211),
    ]
    assert options["keyspace"] == "realtime" and options["table"] == "planes"
    assert options["spark.cassandra.output.consistency.level"] == "ONE"
    assert options["spark.cassandra.output.ttl"] == "60" and options["overwrite"] is False
    write(rows, target, recreate_first=True)
    _, options = standins.written(tmp_path)
    assert options["overwrite"] is True and options["confirm.truncate"] == "true"


def test_documents_reach_the_index(spark, feed, tmp_path):
    good = good_rows(parse_feed(feed(LINE1))).withColumn("objectid", F.lit(1))
    target = elasticsearch("a1,a2", "planes", user="u", password="p", id_field="globalid")
    spark.dataSource.register(standins.sink(target.fmt, str(tmp_path)))
    write(to_documents(good, extra_hashes=False, as_text=False), target)
    got, options = standins.written(tmp_path)
    assert got[0]["geometry"] == [-12.53175, 38.40721] and got[0]["planeid"] == "0"
    assert options["path"] == "planes" and options["es.nodes"] == "a1,a2"
    assert options["es.port"] == "9200" and options["es.mapping.id"] == "globalid"
    assert options["es.net.http.auth.user"] == "u" and options["es.index.auto.create"] == "true"


def test_target_options():
    t = topic("b:9092", "planes")
    assert t.fmt == "kafka" and t.options == {
        "kafka.bootstrap.servers": "b:9092",
        "topic": "planes",
        "kafka.acks": "1",
    }
    assert topic("b:9092", "planes", linger_ms=5).options["kafka.linger.ms"] == "5"
    p = postgres("h", "realtime", "s.planes", "u", "p", connections=8)
    assert p.fmt == "jdbc" and p.path is None
    assert p.options["url"].startswith("jdbc:postgresql://h:5432/realtime?")
    assert "reWriteBatchedInserts=true" in p.options["url"]
    assert "stringtype=unspecified" in p.options["url"]
    assert p.tasks == 8 and p.overwrite_options == {"truncate": "true"}
    assert postgres("h", "realtime", "s.planes", "u", "p").tasks is None
    c = cassandra("k", "t")
    assert c.options["spark.cassandra.output.consistency.level"] == "ANY"
    assert "spark.cassandra.output.ttl" not in c.options


def test_work_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = work_root(spark)
    assert root == (named.rstrip("/") if named else root)
    assert new_work_folder(spark, "x") != new_work_folder(spark, "x")
    assert new_work_folder(spark, "x").startswith(root)
