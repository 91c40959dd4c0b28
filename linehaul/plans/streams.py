"""The registered queries on streams.

Messages arrive in six parts, each a micro-batch (see ``EventTopic``), so results can be told batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linehaul import schemas as S
from linehaul.operators import feed, relay
from linehaul.plans.inputs import PARTS, EventTopic, lines_of, table
from linehaul.session import new_work_folder
from linehaul.sinks import tables
from linehaul.sinks.targets import files
from linehaul.sources.lines import read_line_stream
from linehaul.streaming import (
    BatchMetrics,
    batch_rows,
    count_batches,
    keep_totals,
    run_stream,
    stored_report,
    stored_totals,
    with_stream_objectid,
    write_stream,
)

#: Look for new messages as soon as the last ones are done.
AT_ONCE = {"processingTime": "0 seconds"}
ALL_NOW = {"availableNow": True}

_BASE = [
    "planeid", "ts", "speed", "dist", "bearing", "rtid",
    "orig", "dest", "secstodep", "longitude", "latitude",
]


def _topic(spark: SparkSession, sf: str, folder: str, *columns: str) -> EventTopic:
    rows = table(spark, sf, "events")
    return EventTopic(rows.select(*columns) if columns else rows, folder)


def _arrive(query: StreamingQuery, topics: list[EventTopic], parts: Iterable[int]) -> None:
    """Deliver the parts one after the other to a running query, then stop it."""
    try:
        for part in parts:
            for topic in topics:
                topic.deliver(part)
            query.processAllAvailable()
    finally:
        query.stop()


def _good(topic: EventTopic, **how) -> DataFrame:
    return feed.good_rows(feed.parse_feed(lines_of(topic.stream().drop("props")), **how))


def _ingested(spark: SparkSession, topic: EventTopic, rows: DataFrame, folder: str, shape) -> DataFrame:
    """The stream's micro-batches shaped and written, then read back."""

    def store(batch: DataFrame, batch_id: int) -> None:
        tables.write_batch_once(shape(batch, batch_id), batch_id, f"{folder}/rows")

    _arrive(run_stream(rows, store, f"{folder}/checkpoint", AT_ONCE), [topic], range(PARTS))
    return spark.read.parquet(f"{folder}/rows")


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The feed as a stream, parsed and written batch by batch, then read back."""
    folder = new_work_folder(spark, "stream")
    topic = _topic(spark, sf, folder)
    rows = _good(topic, id_type="bigint").select("event_id", *_BASE)
    return _ingested(spark, topic, rows, folder, lambda b, _: b).drop("batch_id")


def stream_planes16(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_work_folder(spark, "stream")
    topic = _topic(spark, sf, folder)
    stored = _ingested(spark, topic, _good(topic, hashes=True), folder, lambda b, _: feed.to_planes16(b))
    return stored.drop("id", "batch_id").withColumn("ts", F.unix_millis("ts"))


def stream_planes18(spark: SparkSession, sf: str) -> DataFrame:
    """Object ids go on from batch to batch without gap or repeat: which row got which."""
    folder = new_work_folder(spark, "stream")
    topic = _topic(spark, sf, folder)

    def shape(batch: DataFrame, batch_id: int) -> DataFrame:
        return feed.to_planes18(with_stream_objectid(batch, batch_id, f"{folder}/ids", ["event_id"]))

    stored = _ingested(spark, topic, _good(topic, hashes=True), folder, shape)
    ids = [F.col("objectid").cast("long").alias("objectid"), F.col("batch_id").cast("long").alias("batch_id")]
    return stored.select(*ids, F.unix_millis("ts").alias("ts"), "speed", "lon", "lat")


def stream_documents(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_work_folder(spark, "stream")
    topic = _topic(spark, sf, folder)

    def shape(batch: DataFrame, batch_id: int) -> DataFrame:
        numbered = with_stream_objectid(batch, batch_id, f"{folder}/ids", ["event_id"])
        return feed.to_documents(numbered, extra_hashes=False)

    stored = _ingested(spark, topic, _good(topic), folder, shape)
    read = stored.select(F.inline(F.array(F.from_json("document", S.document()))))
    return read.select("objectid", "planeid", "ts", "speed", "orig", "longitude", "latitude")


def stream_batch_report(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed rows counted per micro-batch, with the total so far."""
    folder = new_work_folder(spark, "stream")
    topic = _topic(spark, sf, folder)
    query = count_batches(_good(topic), f"{folder}/counts", f"{folder}/checkpoint", AT_ONCE)
    _arrive(query, [topic], range(PARTS))
    return stored_report(spark, f"{folder}/counts").drop("ts")


def stream_listener_report(spark: SparkSession, sf: str) -> DataFrame:
    """The same report over two starts of a query that writes to a native sink; Spark's own
    figures are stored as they come."""
    folder = new_work_folder(spark, "stream")
    topic = _topic(spark, sf, folder)
    metrics = BatchMetrics(spark, f"{folder}/counts")
    rows = metrics.observe(_good(topic).select("event_id", "ts"))
    try:
        for parts in (range(3), range(3, PARTS)):
            query = write_stream(rows, files(f"{folder}/rows", "parquet"), f"{folder}/checkpoint", AT_ONCE)
            _arrive(query, [topic], parts)
            metrics.wait(query)
    finally:
        metrics.close()
    return stored_report(spark, f"{folder}/counts").drop("ts")


def stream_running_total(spark: SparkSession, sf: str) -> DataFrame:
    """Messages counted in the state store over two starts. The fourth part brings no message that
    counts, and the total is told again."""
    folder = new_work_folder(spark, "stream")
    topic = _topic(spark, sf, folder, "event_id", "props")
    messages = topic.stream().where("event_id % 6 <> 3").select(F.col("props").alias("value"))
    for parts in (range(2), range(2, PARTS)):
        query = keep_totals(messages, f"{folder}/totals", f"{folder}/checkpoint", AT_ONCE)
        _arrive(query, [topic], parts)
    return stored_totals(spark, f"{folder}/totals")


def stream_union_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Three topics read as one stream with one checkpoint. The query is stopped after two parts; the
    others arrive while it is down."""
    folder = new_work_folder(spark, "stream")
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    kinds = ["event_type = 'click'", "event_type = 'view'", "coalesce(event_type NOT IN ('click', 'view'), true)"]
    topics = [EventTopic(rows.where(kind), f"{folder}/{k}") for k, kind in enumerate(kinds)]

    def start(trigger: dict) -> StreamingQuery:
        every = relay.union_streams([t.stream() for t in topics])
        return write_stream(every, files(f"{folder}/rows", "parquet"), f"{folder}/checkpoint", trigger)

    _arrive(start(AT_ONCE), topics, range(2))
    for part in range(2, PARTS):
        for topic in topics:
            topic.deliver(part)
    start(ALL_NOW).awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def stream_relay(spark: SparkSession, sf: str) -> DataFrame:
    """Messages go from topic to topic by Spark's own sink. The third part fails on its first
    try and is repeated by the next start."""
    folder = new_work_folder(spark, "stream")
    topic = _topic(spark, sf, folder, "event_id", "props")

    def start(key) -> StreamingQuery:
        messages = topic.stream().select(key.cast("string").alias("key"), F.col("props").alias("value"))
        return write_stream(relay.relay_messages(messages), files(f"{folder}/rows", "parquet"), f"{folder}/checkpoint", AT_ONCE)

    key = F.col("event_id")
    lost = F.when(key % PARTS == 2, F.raise_error(F.lit("lost on the way"))).otherwise(key)
    try:
        _arrive(start(lost), [topic], range(3))
    except StreamingQueryException as e:
        if "lost on the way" not in str(e):
            raise
    _arrive(start(key), [topic], range(3, PARTS))
    return spark.read.parquet(f"{folder}/rows")


def stream_start_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a folder from its first file on, and from the first start on: two parts are there before, two
    arrive while the queries run and two while they are down."""
    folder = new_work_folder(spark, "stream")
    text = table(spark, sf, "events").select("event_id", F.concat_ws("|", "event_id", "event_type").alias("line"))
    path = f"{folder}/topic"

    def deliver(*parts: int) -> None:
        for part in parts:
            text.where(F.pmod("event_id", F.lit(PARTS)) == part).select("line").write.text(f"{path}/part={part}")

    def run(start: str) -> None:
        options = {"recursiveFileLookup": "true"}
        lines = read_line_stream(spark, path, start, options=options, start_file=f"{folder}/first")
        write_stream(lines.select("line"), files(f"{folder}/{start}", "text"), f"{folder}/checkpoint-{start}", ALL_NOW).awaitTermination()

    deliver(0, 1)
    for parts in ((2, 3), (4, 5)):
        run("latest")
        deliver(*parts)
        run("earliest")
        run("latest")
    got = [spark.read.text(f"{folder}/{s}").select(F.lit(s).alias("start"), "value") for s in ("earliest", "latest")]
    cut = F.split("value", r"\|")
    rows = got[0].union(got[1]).select("start", cut[0].cast("long").alias("event_id"), cut[1].alias("event_type"))
    return rows.groupBy("start", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("sum_event_id"))


def stream_processing_time(spark: SparkSession, sf: str) -> DataFrame:
    """The feed on a processing-time trigger: rows and times of every micro-batch."""
    folder = new_work_folder(spark, "stream")
    topic = _topic(spark, sf, folder)
    query = run_stream(
        _good(topic).select("event_id", "ts"),
        lambda batch, batch_id: tables.write_batch_once(batch, batch_id, f"{folder}/rows"),
        f"{folder}/checkpoint",
        {"processingTime": "100 milliseconds"},
    )
    _arrive(query, [topic], range(PARTS))
    stored = spark.read.parquet(f"{folder}/rows").groupBy(F.col("batch_id").cast("long").alias("batch_id"))
    return stored.agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("sum_ts"))


def stream_dropped_batch(spark: SparkSession, sf: str) -> DataFrame:
    """One batch fails and is given up: what each batch left, and what was noted of it."""
    folder = new_work_folder(spark, "stream")
    topic = _topic(spark, sf, folder, "event_id")

    def action(batch: DataFrame, batch_id: int) -> None:
        tables.write_batch_once(batch, batch_id, f"{folder}/{'lost' if batch_id == 2 else 'rows'}")
        if batch_id == 2:
            raise RuntimeError("target is gone")

    query = run_stream(
        topic.stream(),
        action,
        f"{folder}/checkpoint",
        AT_ONCE,
        on_error="drop",
        drop_log=f"{folder}/dropped",
        rows_log=f"{folder}/counts",
    )
    _arrive(query, [topic], range(PARTS))
    batch = F.col("batch_id").cast("long").alias("batch_id")
    kept = spark.read.parquet(f"{folder}/rows").groupBy(batch).agg(F.count(F.lit(1)).alias("n_kept"))
    noted = spark.read.schema("batch_id long, error string").json(f"{folder}/dropped/*").select("batch_id", "error")
    counted = batch_rows(spark, f"{folder}/counts").withColumnRenamed("rows", "n_counted")
    return kept.join(counted, "batch_id", "full").join(noted, "batch_id", "full")


def stream_repeated_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A batch fails after its write and stops the query; the next start repeats it."""
    folder = new_work_folder(spark, "stream")
    topic = _topic(spark, sf, folder, "event_id", "event_type")
    broken: list[int] = []

    def action(batch: DataFrame, batch_id: int) -> None:
        tables.write_batch_once(batch, batch_id, f"{folder}/rows")
        if batch_id == 3 and not broken:
            broken.append(batch_id)
            raise RuntimeError("lost after the write")

    for parts in (range(4), range(4, PARTS)):
        try:
            _arrive(run_stream(topic.stream(), action, f"{folder}/checkpoint", AT_ONCE), [topic], parts)
        except StreamingQueryException:
            if broken != [3]:
                raise
    return spark.read.parquet(f"{folder}/rows").select(F.col("batch_id").cast("long").alias("batch_id"), "event_id", "event_type")


STREAM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        stream_ingest,
        stream_batch_report,
        stream_planes16,
        stream_planes18,
        stream_documents,
        stream_processing_time,
        stream_dropped_batch,
        stream_repeated_batch,
        stream_listener_report,
        stream_running_total,
        stream_union_topics,
        stream_relay,
        stream_start_positions,
    )
}
