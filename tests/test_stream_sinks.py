from __future__ import annotations

import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from linehaul.operators.relay import union_streams
from linehaul.plans.inputs import PARTS, EventTopic
from linehaul.session import list_names, move, read_text, remove, write_text
from linehaul.sinks import files
from linehaul.sources.lines import read_line_stream
from linehaul.streaming import BatchMetrics, keep_totals, run_stream, stored_report, stored_totals, write_stream

NOW = {"availableNow": True}


def drop_in(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(line + "\n" for line in lines))


def test_several_sources_in_one_checkpoint(spark, tmp_path):
    folders = [tmp_path / f"topic{k}" for k in range(3)]
    for k, f in enumerate(folders):
        drop_in(f, "1.txt", f"a{k}", f"b{k}")

    def run():
        every = union_streams([read_line_stream(spark, str(f), files_per_batch=1) for f in folders])
        write_stream(every.select("line"), files(str(tmp_path / "out"), "text"), str(tmp_path / "cp"), NOW).awaitTermination()

    run()
    drop_in(folders[1], "2.txt", "late")
    drop_in(folders[2], "2.txt", "later")
    run()
    run()
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert got == ["a0", "a1", "a2", "b0", "b1", "b2", "late", "later"]
    # One log of offsets, with the place in each source.
    newest = (tmp_path / "cp" / "offsets" / "1").read_text().splitlines()
    assert len(newest) == 2 + len(folders)


def test_totals_are_told_at_empty_batches_and_over_restarts(spark, tmp_path):
    folder, totals = tmp_path / "in", str(tmp_path / "totals")

    def run():
        lines = read_line_stream(spark, str(folder), files_per_batch=1)
        keep_totals(lines, totals, str(tmp_path / "cp"), NOW).awaitTermination()

    drop_in(folder, "1.txt", "a", "b")
    run()
    drop_in(folder, "2.txt")
    run()
    drop_in(folder, "3.txt", "c")
    run()
    assert sorted(map(tuple, stored_totals(spark, totals).collect())) == [(0, 2), (1, 2), (2, 3)]
    assert stored_totals(spark, str(tmp_path / "none")).count() == 0


def test_a_native_sink_shows_committed_rows_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    drop_in(folder, "1.txt", "a")

    def start(line):
        lines = read_line_stream(spark, str(folder), files_per_batch=1).select(line.alias("line"))
        return write_stream(lines, files(out, "parquet"), str(tmp_path / "cp"), NOW)

    start(F.col("line")).awaitTermination()
    drop_in(folder, "2.txt", "b", "bad")
    # What a lost task leaves in the folder is in no commit.
    (tmp_path / "out" / "part-00099.snappy.parquet").write_bytes(next((tmp_path / "out").glob("part-*")).read_bytes())
    broken = F.when(F.col("line") == "bad", F.raise_error(F.lit("no"))).otherwise(F.col("line"))
    with pytest.raises(StreamingQueryException):
        start(broken).awaitTermination()
    assert [r.line for r in spark.read.parquet(out).collect()] == ["a"]
    start(F.col("line")).awaitTermination()
    assert sorted(r.line for r in spark.read.parquet(out).collect()) == ["a", "b", "bad"]


def test_figures_of_a_listener(spark, tmp_path):
    folder, log = tmp_path / "in", str(tmp_path / "counts")
    metrics = BatchMetrics(spark, log)
    for name, lines in [("1.txt", ["a", "b"]), ("2.txt", []), ("3.txt", ["c"])]:
        drop_in(folder, name, *lines)
        rows = metrics.observe(read_line_stream(spark, str(folder)))
        before = time.time() * 1000
        query = write_stream(rows, files(str(tmp_path / "out"), "parquet"), str(tmp_path / "cp"), NOW)
        query.awaitTermination()
        metrics.wait(query)
    metrics.close()
    every = stored_report(spark, log, empty_batches=True).collect()
    assert [(r.batch_id, r["count"], r.total) for r in every] == [(0, 2, 2), (1, 0, 2), (2, 1, 3)]
    assert before - 1000 <= every[-1].ts <= time.time() * 1000
    # A query that is over and unknown to the listener does not hold its reader up for long.
    other = run_stream(read_line_stream(spark, str(folder)), lambda b, i: None, str(tmp_path / "cp2"), NOW)
    other.awaitTermination()
    metrics.wait(other, seconds=0.1)


def test_parts_of_a_topic_arrive_whole(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("event_id"))
    topic = EventTopic(rows.where("event_id % 6 <> 1"), str(tmp_path))
    assert os.listdir(topic.path) == []
    for part in (2, 1):
        topic.deliver(part)
    got = spark.read.option("recursiveFileLookup", "true").parquet(topic.path).collect()
    assert {r.event_id for r in got} == {i for i in range(20) if i % PARTS == 2}
    assert topic.stream().columns == ["event_id"]


def test_small_files(spark, tmp_path):
    path = f"{tmp_path}/a/b.json"
    for text in ("grün\n", ""):
        write_text(spark, path, text)
        assert read_text(spark, path) == text and list_names(spark, f"{tmp_path}/a")[-1:] == ["b.json"]
    move(spark, f"{tmp_path}/a", f"{tmp_path}/x/y")
    assert read_text(spark, f"{tmp_path}/x/y/b.json") == ""
    with pytest.raises(OSError):
        move(spark, f"{tmp_path}/a", f"{tmp_path}/z")
    remove(spark, f"{tmp_path}/x")
    remove(spark, f"{tmp_path}/x")
    assert list_names(spark, f"{tmp_path}/x") == []
