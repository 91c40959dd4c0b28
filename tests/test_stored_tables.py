from __future__ import annotations

import os
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from linehaul.sinks import KeyedTable, WindowTable

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
HOUR_US = 3_600_000_000
ROWS = StructType().add("k", LongType()).add("t", StringType()).add("n", LongType()).add("v", StringType())


def keyed(spark, tmp_path, buckets=4):
    return KeyedTable(spark, str(tmp_path / "keyed"), ROWS, ("k", "t"), "n", buckets)


def batch(spark, n, keys=range(40)):
    return spark.createDataFrame([(k, "x" if k % 2 else None, n, f"v{n}") for k in keys], ROWS)


def test_the_current_rows_are_read_without_a_shuffle(spark, tmp_path):
    table = keyed(spark, tmp_path)
    assert table.current().count() == 0
    for n in (2, 3, 1):
        table.add(batch(spark, n))
    table.add(batch(spark, 9, [0, 1]))
    table.add(batch(spark, 9, [0, 1]))
    got = {(r.k, r.t): (r.n, r.v) for r in table.current().collect()}
    assert got == {(k, "x" if k % 2 else None): (9, "v9") if k < 2 else (3, "v3") for k in range(40)}
    plan = table.current()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_a_batch_with_many_rows_of_a_key_keeps_the_last(spark, tmp_path):
    table = keyed(spark, tmp_path)
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), F.lit("x").alias("t"), F.col("id").alias("n"), F.lit("v").alias("v"), F.lit(1).alias("more"))
    table.add(rows)
    stored = spark.read.parquet(table.path)
    assert stored.count() == 3 and {r.n for r in stored.collect()} == {2997, 2998, 2999}


def test_full_levels_are_merged_and_other_buckets_left(spark, tmp_path):
    table = keyed(spark, tmp_path)
    for n in range(3):
        table.add(batch(spark, n))
        assert table.compact(fan=4) == 0
    before = table.current().orderBy("k").collect()
    assert {len(f) for f in table.files().values()} == {3}
    table.add(batch(spark, 3, [5]))
    names = table.files()
    assert table.compact(fan=4) == 1
    after = table.files()
    changed = [b for b in names if names[b] != after[b]]
    assert len(changed) == 1 and len(after[changed[0]]) == 1
    assert len([1 for f in after.values() if len(f) == 3]) == 3
    got = table.current().orderBy("k").collect()
    assert [r for r in got if r.k != 5] == [r for r in before if r.k != 5] and [r.v for r in got if r.k == 5] == ["v3"]


def test_large_files_wait_for_others_of_their_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("linehaul.sinks.keyed_tables.LEVEL_BYTES", 3000)
    table = keyed(spark, tmp_path, buckets=1)
    table.add(batch(spark, 0, range(2000)))
    large = table.files()[0]
    for n in range(1, 4):
        table.add(batch(spark, n, [n]))
    assert table.compact(fan=3) == 1
    left = table.files()[0]
    assert large[0] in left and len(left) == 2 and table.current().count() == 2000


def test_a_stop_between_adding_and_deleting_shows_every_row_once(spark, tmp_path, monkeypatch):
    table = keyed(spark, tmp_path)
    for n in range(4):
        table.add(batch(spark, n))
    before = sorted(map(str, table.current().collect()))

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr("linehaul.sinks.keyed_tables.remove", stop)
        with pytest.raises(KeyboardInterrupt):
            table.compact(fan=4)
    assert sorted(map(str, table.current().collect())) == before
    assert table.compact(fan=4) == 4
    assert sorted(map(str, table.current().collect())) == before and {len(f) for f in table.files().values()} == {1}


def test_the_description_can_be_given_anew(spark, tmp_path):
    table = keyed(spark, tmp_path)
    table.add(batch(spark, 1))
    table.forget()
    assert keyed(spark, tmp_path).current().count() == 40


def windows(spark, tmp_path, hours=HOUR_US):
    return WindowTable(spark, str(tmp_path / "windows"), StructType().add("id", LongType()), hours)


def minutes(spark, start, n):
    """A row a minute."""
    rows = spark.range(start, start + n)
    return rows.select("id", (F.lit(START) + F.expr("make_dt_interval(0, 0, id)")).alias("at"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_batch_counts_once(spark, tmp_path):
    table = windows(spark, tmp_path)
    assert table.read().count() == 0 and table.read().columns == ["id", "written"]
    for _ in range(2):
        table.append(minutes(spark, 0, 90), 0, "at")
    table.append(minutes(spark, 90, 30), 1, "at")
    assert ids(table.read()) == list(range(120))
    assert {w: len(f) for w, f in table.listed().folders.items()} == {w: n for w, n in zip(sorted(table.listed().folders), (1, 2))}
    assert windows(spark, tmp_path).listed().last_batch == 1


def test_a_try_that_stopped_before_the_list_is_repeated_whole(spark, tmp_path, monkeypatch):
    table = windows(spark, tmp_path)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(WindowTable, "_put", stop)
        with pytest.raises(KeyboardInterrupt):
            table.append(minutes(spark, 0, 120), 0, "at")
    assert table.read().count() == 0
    table.append(minutes(spark, 0, 60), 0, "at")
    assert ids(table.read()) == list(range(60))


def test_closed_windows_are_merged_once(spark, tmp_path):
    table = windows(spark, tmp_path)
    for k in range(4):
        table.append(minutes(spark, 0, 150).where(F.col("id") % 4 == k), k, "at")
    reader = table.read()
    assert len(table.compact(START + timedelta(minutes=149))) == 2
    assert table.compact(START + timedelta(minutes=149)) == []
    folders = table.listed().folders
    assert [len(folders[w]) for w in sorted(folders)] == [1, 1, 4]
    for w in sorted(folders)[:2]:
        assert len(list((Path(table.path) / folders[w][0]).glob("part-*"))) == 1
    # Who started before the merge still reads its own list's files, and no row comes twice.
    assert ids(reader) == ids(table.read()) == list(range(150))
    table.clean()
    assert ids(reader) == list(range(150))
    table.append(minutes(spark, 150, 10), 4, "at")
    assert len(table.clean()) == 8
    assert ids(table.read()) == list(range(160))
    assert sum(len(f) for _, _, f in os.walk(table.path) if any(n.startswith("part-") for n in f)) > 0


def test_windows_whose_time_is_up_go_unread(spark, tmp_path):
    table = windows(spark, tmp_path)
    table.append(minutes(spark, 0, 300), 0, "at")
    for f in table.listed().folders[min(table.listed().folders)]:
        for part in (Path(table.path) / f).glob("part-*"):
            part.write_bytes(b"broken")  # a read would fail
    live = {f for w, fs in table.listed().folders.items() for f in fs if w % 5 > 2}
    gone = table.expire(START + timedelta(minutes=300), 150 * 60)
    assert len(gone) == 2 and ids(table.read()) == list(range(151, 300))
    assert {f for fs in table.listed().folders.values() for f in fs} - live and table.expire(START + timedelta(minutes=300), -1) == []
    table.append(minutes(spark, 300, 1), 1, "at")
    table.clean()
    names = {p.parent.name for p in Path(table.path).rglob("part-*.parquet")}
    assert not names & {f"window={w}" for w in gone}
    assert table.expire(START + timedelta(days=9), 60) and table.read().count() == 0


def test_ranges_open_their_windows_only(spark, tmp_path):
    table = windows(spark, tmp_path)
    table.append(minutes(spark, 0, 300), 0, "at")
    part = table.read(START + timedelta(minutes=70), START + timedelta(minutes=120))
    assert ids(part) == list(range(70, 120)) and len(part.inputFiles()) == 1


def test_write_time_is_now_unless_given(spark, tmp_path):
    table = windows(spark, tmp_path)
    rows = minutes(spark, 0, 2).withColumn("at", F.when(F.col("id") == 1, F.col("at")))
    table.append(rows, 0, "at")
    table.append(rows, 1)
    new = table.read(datetime.now(timezone.utc) - timedelta(hours=1))
    assert ids(new) == [0, 0, 1]


def test_two_writers(spark, tmp_path):
    table, other = windows(spark, tmp_path), windows(spark, tmp_path)
    table.append(minutes(spark, 0, 10), 0, "at")
    stale = other.listed()
    table.append(minutes(spark, 10, 10), 1, "at")
    with pytest.raises(OSError):
        other._put(stale, 1, {})
    assert ids(table.read()) == list(range(20))
