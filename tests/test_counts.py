from __future__ import annotations

import random

from pyspark.sql import functions as F

from linehaul.operators import counts


def test_running_total_over_many_blocks(spark):
    rng = random.Random(3)
    batches = rng.sample(range(-20_000, 60_000), 3000)
    data = [(b, rng.randint(0, 9)) for b in batches]
    got = counts.running_total(spark.createDataFrame(data, "batch long, count long"))
    total, want = 0, []
    for b, n in sorted(data):
        total += n
        want.append((b, n, total))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_report_and_empty_batches(spark):
    rows = spark.createDataFrame([(b,) for b in (5, 5, 9, 7, 5)], "batch long")
    report = counts.batch_report(rows).orderBy("ts")
    assert [tuple(r) for r in report.collect()] == [(5, 3, 3), (7, 1, 4), (9, 1, 5)]
    named = counts.batch_report(rows, ts_of_batch="batch * 10")
    assert {r.ts for r in named.collect()} == {50, 70, 90}
    every = counts.with_empty_batches(counts.batch_counts(rows, "batch"), 4, 9)
    got = counts.running_total(every).orderBy("batch").collect()
    assert [tuple(r) for r in got] == [
        (4, 0, 0), (5, 3, 3), (6, 0, 3), (7, 1, 4), (8, 0, 4), (9, 1, 5),
    ]


def test_load_report(spark, tmp_path):
    import time

    started = int(time.time() * 1000) - 1
    rows = spark.range(100).withColumn("part", F.col("id") % 3)
    rows.write.partitionBy("part").parquet(str(tmp_path / "t"))
    report = counts.load_report(spark, str(tmp_path / "t"), ["part"], started)
    got = {r.part: r for r in report.collect()}
    assert {k: r.rows for k, r in got.items()} == {0: 34, 1: 33, 2: 33}
    assert all(0 <= r.seconds < 60 for r in got.values())
    total = counts.load_total(report).first()
    assert total.rows == 100 and total.seconds == max(r.seconds for r in got.values())
    rows.select(F.col("id").cast("string")).repartition(4).write.text(str(tmp_path / "copy"))
    tasks = counts.load_report(spark, str(tmp_path / "copy"), None, started, "text").collect()
    assert sorted(r.task for r in tasks) == [0, 1, 2, 3] and sum(r.rows for r in tasks) == 100
    assert all(0 <= r.seconds < 60 for r in tasks)
    plain = counts.load_report(spark, str(tmp_path / "t"), ["part"])
    assert plain.columns == ["part", "rows"] and counts.load_total(plain).first().rows == 100
