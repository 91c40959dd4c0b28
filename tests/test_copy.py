from __future__ import annotations

import os
from pathlib import Path

import pytest
from conftest import LINE1, LINE2
from pyspark.sql import functions as F

from linehaul import schemas as S
from linehaul.operators import counts
from linehaul.operators.feed import copy_line, good_rows, parse_feed, to_copy_rows
from linehaul.sinks.copy import copy_lines

HERE = Path(__file__).resolve().parent


@pytest.fixture()
def target(spark, tmp_path):
    spark.sparkContext.addPyFile(str(HERE / "copy_standins.py"))
    return tmp_path


def sent(folder) -> list[str]:
    return sorted(line for f in folder.glob("*.csv") for line in f.read_text().splitlines())


@pytest.mark.parametrize("way", ["streaming", "reading"])
def test_copy_text_of_the_feed(spark, target, feed, way):
    rows = to_copy_rows(good_rows(parse_feed(feed(LINE1, LINE2, "bad"), hashes=True)))
    texts = copy_line(rows)
    columns = [f.name for f in S.COPY16]
    report = copy_lines(texts, f"copy_standins:{way}", "planes", columns, str(target)).collect()
    got = sent(target)
    assert len(got) == 2 and sum(r.rows for r in report) == 2
    assert sum(r.bytes for r in report) == sum(len(line.encode()) + 1 for line in got)
    assert all(r.started_ms <= r.ended_ms and r.seconds >= 0 for r in report)
    assert (target / "sql").read_text() == f"COPY planes ({', '.join(columns)}) FROM STDIN WITH (FORMAT csv, NULL 'null')"
    read = spark.createDataFrame([(x,) for x in got], "copy_line string")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.COPY16)
    fields = read.select(F.inline(F.array(F.from_csv("copy_line", schema, {"escape": '"'}))))
    assert {r.orig for r in fields.collect()} == {"Harbour Field", "Old Mill Airport"}


def test_a_transaction_a_task_and_a_bound_on_them(spark, target):
    lines = spark.range(1000, numPartitions=8).select(F.concat(F.lit("é"), F.col("id").cast("string")).alias("line"))
    report = copy_lines(lines, "copy_standins:streaming", "t", ["line"], str(target), connections=3)
    assert report.count() == 3 and report.agg(F.sum("rows")).first()[0] == 1000
    assert sent(target) == sorted(f"é{i}" for i in range(1000)) and len(list(target.glob("*.csv"))) == 3


def test_a_lost_connection_raises_and_leaves_no_part_of_its_task(spark, target):
    (target / "fail").touch()
    lines = spark.createDataFrame([("bad",), ("bad too",)], "line string").coalesce(1)
    with pytest.raises(Exception, match="connection lost"):
        copy_lines(lines, "copy_standins:streaming", "t", ["line"], str(target))
    assert sent(target) == []
    copy_lines(lines, "copy_standins:streaming", "t", ["line"], str(target))
    assert sent(target) == ["bad", "bad too"]


def test_nothing_to_send(spark, target):
    report = copy_lines(spark.createDataFrame([], "line string"), "copy_standins:streaming", "t", ["line"], str(target))
    assert sum(r.rows for r in report.collect()) == 0 and sent(target) == []


def test_figures_of_a_load_from_its_tasks(spark, tmp_path):
    rows = spark.range(1000, numPartitions=5)
    shuffled = rows.groupBy((F.col("id") % 7).alias("k")).count().repartition(3)
    metrics = counts.load_metrics(spark, lambda: rows.write.parquet(f"{tmp_path}/a"))
    got = metrics.collect()
    assert sorted((r.task, r.rows) for r in got) == [(k, 200) for k in range(5)]
    size = sum(os.path.getsize(f) for f in Path(tmp_path / "a").glob("part-*"))
    assert sum(r.bytes for r in got) == size and all(r.seconds >= 0 and r.started_ms > 0 for r in got)
    assert counts.load_total(metrics).first().rows == 1000
    again = counts.load_metrics(spark, lambda: shuffled.write.parquet(f"{tmp_path}/b"))
    assert again.agg(F.sum("rows")).first()[0] == 7
    assert counts.load_metrics(spark, lambda: None).count() == 0
    with pytest.raises(ValueError):
        counts.load_metrics(spark, lambda: int("x"))
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
