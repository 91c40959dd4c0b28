from __future__ import annotations

import json
import os
import shutil
import time

import pytest
import standins
from conftest import LINE1, LINE2
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from linehaul.operators.feed import (
    good_rows,
    parse_feed,
    rejected_rows,
    to_copy_rows,
    to_documents,
    to_planes12,
    to_planes16,
    to_planes18,
)
from linehaul.operators.relay import relay_messages, union_streams
from linehaul.session import hadoop_path, new_work_folder
from linehaul.sinks import files, tables, write_batch_once, writer_to
from linehaul.sources.lines import read_line_stream, read_lines
from linehaul.sources.topics import read_topic, topic_options, values
from linehaul.streaming import (
    batch_rows,
    count_batches,
    run_stream,
    stored_report,
    topic_total,
    with_stream_objectid,
)

NOW = {"availableNow": True}


@pytest.fixture()
def folder(tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    return path


def drop_in(folder, name, *lines, age=0):
    file = folder / name
    file.write_text("".join(line + "\n" for line in lines))
    when = time.time() - age
    os.utime(file, (when, when))


def three_files(folder):
    drop_in(folder, "1.txt", LINE1, "bad", age=30)
    drop_in(folder, "2.txt", LINE2, LINE2, LINE2, age=20)
    drop_in(folder, "3.txt", LINE1, age=10)


def stored(spark, path):
    return spark.read.parquet(str(path))


def test_batch_and_stream_give_the_same_rows(spark, folder, tmp_path):
    three_files(folder)

    def shape(lines):
        rows = to_planes12(good_rows(parse_feed(lines, id_type="bigint")))
        return rows.drop("file")

    stream = shape(read_line_stream(spark, str(folder), files_per_batch=1))
    out = str(tmp_path / "out")
    query = run_stream(
        stream, lambda b, i: write_batch_once(b, i, out), str(tmp_path / "cp"), NOW
    )
    query.awaitTermination()
    want = sorted(tuple(r) for r in shape(read_lines(spark, str(folder))).collect())
    got = stored(spark, out)
    assert sorted(tuple(r) for r in got.drop("batch_id").collect()) == want and len(want) == 5
    assert got.select("batch_id").distinct().count() == 3


SHAPES = {
    "planes12": lambda rows: to_planes12(rows, id_from="uuid"),
    "planes16": to_planes16,
    "planes18": to_planes18,
    "copy": to_copy_rows,
    "copy_global": lambda rows: to_copy_rows(rows, with_globalid=True),
    "documents": to_documents,
}


@pytest.mark.parametrize("name", SHAPES)
def test_every_shape_is_ingested_from_a_stream(spark, folder, tmp_path, name):
    three_files(folder)
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ids")
    good = good_rows(parse_feed(read_line_stream(spark, str(folder)), hashes=True))

    def ingest(batch, batch_id):
        rows = with_stream_objectid(batch, batch_id, ledger) if name in WITH_ID else batch
        write_batch_once(SHAPES[name](rows), batch_id, out)

    run_stream(good, ingest, str(tmp_path / "cp"), NOW).awaitTermination()
    rows = stored(spark, out)
    assert rows.count() == 5
    if name == "planes18":
        assert sorted(r.objectid for r in rows.collect()) == [1, 2, 3, 4, 5]
    if name == "documents":
        assert len({json.loads(r.document)["globalid"] for r in rows.collect()}) == 5


WITH_ID = {"planes18", "documents"}


def test_rejects_of_a_stream(spark, folder, tmp_path):
    three_files(folder)
    stream = parse_feed(read_line_stream(spark, str(folder)))
    write = writer_to(files(str(tmp_path / "out"), "parquet"))
    run_stream(rejected_rows(stream), write, str(tmp_path / "cp"), NOW).awaitTermination()
    row = stored(spark, tmp_path / "out").first()
    assert (row.file, row.line, row.reject_reason) == ("1.txt", "bad", "too_few_fields")


def test_a_failed_batch_is_dropped_and_noted(spark, folder, tmp_path):
    three_files(folder)
    out = str(tmp_path / "out")

    def action(batch, batch_id):
        if batch_id == 1:
            raise RuntimeError("target is gone")
        write_batch_once(batch, batch_id, out)

    stream = read_line_stream(spark, str(folder), files_per_batch=1)
    log = str(tmp_path / "dropped")
    query = run_stream(stream, action, str(tmp_path / "cp"), NOW, on_error="drop", drop_log=log)
    query.awaitTermination()
    assert query.exception() is None
    rows = stored(spark, out).collect()
    assert sorted((r.batch_id, r.file) for r in rows) == [
        (0, "1.txt"), (0, "1.txt"), (2, "3.txt"),
    ]
    note = spark.read.json(log + "/*").first()
    assert note.batch_id == 1 and "target is gone" in note.error


def test_an_error_in_the_rows_drops_the_batch_too(spark, folder, tmp_path):
    three_files(folder)
    strict = parse_feed(read_line_stream(spark, str(folder), files_per_batch=1), mode="failfast")
    out = str(tmp_path / "out")
    query = run_stream(
        strict.select("file", "ts"),
        lambda b, i: write_batch_once(b, i, out),
        str(tmp_path / "cp"),
        NOW,
        on_error="drop",
    )
    query.awaitTermination()
    rows = spark.read.schema("file string").parquet(f"{out}/batch_id=1", f"{out}/batch_id=2")
    assert rows.count() == 4


def test_a_failed_batch_stops_the_query_and_is_repeated(spark, folder, tmp_path):
    three_files(folder)
    out, broken = str(tmp_path / "out"), [True]

    def action(batch, batch_id):
        write_batch_once(batch, batch_id, out)
        if batch_id == 1 and broken[0]:
            raise RuntimeError("target is gone")

    def start():
        stream = read_line_stream(spark, str(folder), files_per_batch=1)
        return run_stream(stream, action, str(tmp_path / "cp"), NOW)

    with pytest.raises(StreamingQueryException, match="target is gone"):
        start().awaitTermination()
    broken[0] = False
    start().awaitTermination()
    assert stored(spark, out).count() == 6
    with pytest.raises(ValueError):
        run_stream(spark.readStream.format("rate").load(), action, "x", on_error="ignore")


def test_counts_survive_a_restart(spark, folder, tmp_path):
    three_files(folder)
    counts, cp = str(tmp_path / "counts"), str(tmp_path / "cp")

    def run():
        stream = read_line_stream(spark, str(folder), files_per_batch=1)
        good = good_rows(parse_feed(stream))
        count_batches(good, counts, cp, NOW).awaitTermination()

    run()
    drop_in(folder, "4.txt", "bad")
    run()
    drop_in(folder, "5.txt", LINE1, LINE1)
    run()
    report = stored_report(spark, counts).collect()
    assert [(r.batch_id, r["count"], r.total) for r in report] == [
        (0, 1, 1), (1, 3, 4), (2, 1, 5), (4, 2, 7),
    ]
    every = stored_report(spark, counts, empty_batches=True).collect()
    assert [(r["count"], r.total) for r in every] == [(1, 1), (3, 4), (1, 5), (0, 5), (2, 7)]
    assert all(a.ts <= b.ts for a, b in zip(every, every[1:]))


def test_running_total_in_the_state_store(spark, folder, tmp_path):
    three_files(folder)
    totals = []

    def run():
        stream = topic_total(read_line_stream(spark, str(folder), files_per_batch=1))
        query = (
            stream.writeStream.outputMode("complete")
            .foreachBatch(lambda b, i: totals.append(b.first().total))
            .option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(**NOW)
            .start()
        )
        query.awaitTermination()

    run()
    drop_in(folder, "4.txt", "x")
    run()
    assert totals == [2, 5, 6, 7]


def test_rows_are_counted_while_they_pass(spark, folder, tmp_path):
    three_files(folder)
    stream = read_line_stream(spark, str(folder), files_per_batch=1)
    log = str(tmp_path / "counts")
    query = run_stream(
        stream,
        lambda b, i: b.write.format("noop").mode("append").save(),
        str(tmp_path / "cp"),
        NOW,
        rows_log=log,
    )
    query.awaitTermination()
    assert sorted(map(tuple, batch_rows(spark, log).collect())) == [(0, 2), (1, 3), (2, 1)]
    assert batch_rows(spark, str(tmp_path / "none")).count() == 0


def test_old_notes_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "LOG_BATCHES", 4)
    log = str(tmp_path / "log")
    for i in [*range(10), 9]:
        tables.keep_batch(spark, log, i, "rows long", [(i * 10,)])
    notes = tables.read_batches(spark, log, "rows long").orderBy("batch_id").collect()
    assert [(r.batch_id, r.rows) for r in notes] == [(i, i * 10) for i in range(10)]
    assert sorted(n for n in os.listdir(log) if not n.startswith(".")) == ["batch=8", "batch=9", "block=0", "block=1"]


def test_a_stop_while_old_notes_are_deleted_loses_none(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "LOG_BATCHES", 4)
    log = tmp_path / "log"
    for i in range(5):
        tables.keep_batch(spark, str(log), i, "rows long", [(i * 10,)])
    shutil.copytree(log, tmp_path / "before")
    tables.keep_batch(spark, str(log), 5, "rows long", [(50,)])
    for left in ([2, 3], [3], []):  # single notes that were still there at the stop
        for i in left:
            shutil.copytree(tmp_path / "before" / f"batch={i}", log / f"batch={i}")
        tables.keep_batch(spark, str(log), 5, "rows long", [(50,)])
        notes = tables.read_batches(spark, str(log), "rows long").collect()
        assert sorted((r.batch_id, r.rows) for r in notes) == [(i, i * 10) for i in range(6)]
        names = [n for n in os.listdir(log) if not n.startswith(".")]
        assert sum(n.startswith("block=0") for n in names) == 1 and len(names) == 3


def test_a_stop_while_a_block_is_written_loses_none(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "LOG_BATCHES", 4)
    log = tmp_path / "log"
    for i in range(5):
        tables.keep_batch(spark, str(log), i, "rows long", [(i * 10,)])
    (log / "block=0" / "_temporary").mkdir(parents=True)
    tables.keep_batch(spark, str(log), 5, "rows long", [(50,)])
    notes = tables.read_batches(spark, str(log), "rows long").collect()
    assert sorted((r.batch_id, r.rows) for r in notes) == [(i, i * 10) for i in range(6)]


def test_latest_takes_new_files_only(spark, folder, tmp_path):
    three_files(folder)
    out, first = str(tmp_path / "out"), str(tmp_path / "cp-start")

    def run():
        stream = read_line_stream(spark, str(folder), start="latest", start_file=first)
        run_stream(
            stream, lambda b, i: write_batch_once(b, i, out), str(tmp_path / "cp"), NOW
        ).awaitTermination()

    read_line_stream(spark, str(folder), start="latest", start_file=first)
    drop_in(folder, "4.txt", "new", age=-5)
    run()
    assert [r.line for r in stored(spark, out).collect()] == ["new"]
    drop_in(folder, "5.txt", "came while the stream was down", age=-1)
    run()
    assert stored(spark, out).count() == 2
    with pytest.raises(ValueError):
        read_line_stream(spark, str(folder), start="latest")
    with pytest.raises(ValueError):
        read_line_stream(spark, str(folder), start="middle")


def test_a_second_trigger_interval(spark, folder, tmp_path):
    three_files(folder)
    out = str(tmp_path / "out")
    query = run_stream(
        read_line_stream(spark, str(folder)),
        lambda b, i: write_batch_once(b, i, out),
        str(tmp_path / "cp"),
        {"processingTime": "200 milliseconds"},
    )
    query.processAllAvailable()
    query.stop()
    assert stored(spark, out).count() == 6


def test_objectids_go_on_and_repeat_on_retry(spark, folder, tmp_path):
    three_files(folder)
    out, ledger, broken = str(tmp_path / "out"), str(tmp_path / "ids"), [True]

    def action(batch, batch_id):
        numbered = with_stream_objectid(batch, batch_id, ledger, ["file", "line"])
        write_batch_once(numbered, batch_id, out)
        if batch_id == 1 and broken[0]:
            raise RuntimeError("lost after the write")

    def start():
        stream = read_line_stream(spark, str(folder), files_per_batch=1)
        return run_stream(stream, action, str(tmp_path / "cp"), NOW)

    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    broken[0] = False
    start().awaitTermination()
    rows = stored(spark, out).collect()
    assert sorted((r.batch_id, r.objectid) for r in rows) == [
        (0, 1), (0, 2), (1, 3), (1, 4), (1, 5), (2, 6),
    ]
    assert len([n for n in os.listdir(ledger) if n.startswith("batch_id=")]) == 2


def test_staged_rows_of_a_batch_are_removed(spark, folder, tmp_path):
    three_files(folder)
    made = []

    def action(batch, batch_id):
        made.append(new_work_folder(spark, "test"))
        batch.write.parquet(made[-1])
        if batch_id == 1:
            raise RuntimeError("after staging")

    stream = read_line_stream(spark, str(folder), files_per_batch=1)
    query = run_stream(stream, action, str(tmp_path / "cp"), NOW, on_error="drop")
    query.awaitTermination()
    assert len(made) == 3
    for path in made:
        fs, p = hadoop_path(spark, path)
        assert not fs.exists(p)
    fs, p = hadoop_path(spark, new_work_folder(spark, "kept"))
    assert not fs.exists(p)


def test_topic_options():
    o = topic_options("b:9092", "a,b", "earliest", "g", 16, {"failOnDataLoss": "false"})
    assert o == {
        "kafka.bootstrap.servers": "b:9092",
        "subscribe": "a,b",
        "startingOffsets": "earliest",
        "kafka.group.id": "g",
        "minPartitions": "16",
        "failOnDataLoss": "false",
    }
    assert topic_options("b", "t")["startingOffsets"] == "latest"


def test_a_batch_read_keeps_given_offsets():
    seen = {}

    class Reader:
        def format(self, source):
            return self

        def options(self, **options):
            seen.update(options)
            raise InterruptedError

    class Session:
        read = Reader()

    some = '{"planes":{"0":5}}'
    for options, want in (
        (topic_options("b", "planes"), ("earliest", "latest")),
        (topic_options("b", "planes", extra={"startingOffsets": some}), (some, "latest")),
        (topic_options("b", "planes", extra={"endingOffsets": some}), ("earliest", some)),
    ):
        with pytest.raises(InterruptedError):
            read_topic(Session(), options, streaming=False)
        assert (seen["startingOffsets"], seen["endingOffsets"]) == want
    assert "kafka.group.id" not in topic_options("b", "t")
    with pytest.raises(ValueError):
        topic_options("b", "t", "somewhere")


def test_topics_relay_union_and_start(spark, folder, tmp_path):
    spark.dataSource.register(standins.TopicStandIn)
    (folder / "t1").write_text("k1\tv1\nk2\tv2\n")
    (folder / "t2").write_text("k3\tv3\n")

    def topic(names, start="earliest"):
        return read_topic(spark, topic_options(str(folder), names, start), source="topic_standin")

    def rows(stream, name):
        out, cp = str(tmp_path / name), str(tmp_path / f"{name}-cp")

        def finish():
            query = run_stream(stream, lambda b, i: write_batch_once(b, i, out), cp)
            query.processAllAvailable()
            query.stop()
            return sorted(tuple(r) for r in stored(spark, out).drop("batch_id").collect())

        return finish

    every = [("k1", "v1"), ("k2", "v2"), ("k3", "v3")]
    assert rows(relay_messages(topic("t1,t2")), "both")() == every
    union = union_streams([topic("t1"), topic("t2")])
    assert rows(relay_messages(union), "union")() == every
    assert rows(values(topic("t1")), "values")() == [("v1",), ("v2",)]

    late = rows(relay_messages(topic("t1", "latest")), "late")
    (folder / "t1").write_text("k1\tv1\nk2\tv2\n")
    assert late() == []
    with open(folder / "t1", "a") as f:
        f.write("k9\tv9\n")
    assert late() == [("k9", "v9")]

    batch = read_topic(
        spark, topic_options(str(folder), "t1"), streaming=False, source="topic_standin"
    )
    assert sorted((r.key, r.offset) for r in batch.collect()) == [("k1", 0), ("k2", 1), ("k9", 2)]
    assert batch.select(F.max("topic")).first()[0] == "t1"
