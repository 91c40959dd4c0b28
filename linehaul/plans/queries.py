"""The registered queries: every operator applied to whole tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linehaul import schemas as S
from linehaul.functions.geo import wkt_point
from linehaul.functions.ids import stable_uuid, with_objectid, with_uuid
from linehaul.functions.text import first_of_list, split_list
from linehaul.functions.times import MINUTE_US, WEEK_US, chunk_number
from linehaul.operators import counts, feed, keyed, relay, search
from linehaul.plans.inputs import (
    PARTS,
    document_files,
    document_lines,
    events,
    good_feed,
    long_lines_of,
    parsed_feed,
    table,
)
from linehaul.plans.streams import STREAM_QUERIES
from linehaul.session import new_work_folder
from linehaul.sinks import KeyedTable, WindowTable, tables
from linehaul.sinks.targets import files, write
from linehaul.sources.lines import full_match, list_files, list_objects, read_lines

Query = Callable[[SparkSession, str], DataFrame]

SEARCH_TEXT = "the"
URL_REGEX = r"https?://[^/]+/en/\d+(\.html)?"
SOURCE_REGEX = r"src[0-9]*[13579]"
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US
TTL_SECONDS = 7 * 24 * 3600
RANGE = (datetime(2024, 1, 10, 12), datetime(2024, 1, 20))

_BASE = [
    "planeid", "ts", "speed", "dist", "bearing", "rtid",
    "orig", "dest", "secstodep", "longitude", "latitude",
]


def feed_parse_typed(spark: SparkSession, sf: str) -> DataFrame:
    return good_feed(spark, sf).select("event_id", *_BASE)


def feed_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return feed.rejected_rows(parsed_feed(spark, sf)).select("event_id", "reject_reason")


def feed_id_event_time(spark: SparkSession, sf: str) -> DataFrame:
    rows = feed.to_planes12(good_feed(spark, sf, id_type="bigint"))
    rows = tables.conform(rows, S.planes12())
    return rows.withColumn("ts", F.unix_millis("ts"))


def feed_uuid_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = feed.to_planes12(good_feed(spark, sf), id_from="uuid")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("id").alias("n_ids"),
        F.count_if(F.length("id") == 36).alias("n_full_length"),
    )


def feed_wkt_point(spark: SparkSession, sf: str) -> DataFrame:
    return good_feed(spark, sf).select(
        "event_id", wkt_point("lon_token", "lat_token").alias("geometry")
    )


def feed_hash_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = feed.to_planes16(good_feed(spark, sf, hashes=True))
    return rows.drop("id").withColumn("ts", F.unix_millis("ts"))


def feed_global_ids(spark: SparkSession, sf: str) -> DataFrame:
    good = good_feed(spark, sf, hashes=True).drop("lon_token", "lat_token")
    numbered = with_objectid(good, ["event_id"])
    rows = feed.to_planes18(numbered)
    return (
        rows.drop("globalid")
        .withColumn("ts", F.unix_millis("ts"))
        .withColumn("point_lon", F.col("geometry.lon"))
        .withColumn("point_lat", F.col("geometry.lat"))
        .drop("geometry")
    )


def feed_copy_rows(spark: SparkSession, sf: str) -> DataFrame:
    return feed.to_copy_rows(good_feed(spark, sf, hashes=True)).drop("id")


def feed_copy_rows_global(spark: SparkSession, sf: str) -> DataFrame:
    rows = feed.to_copy_rows(good_feed(spark, sf, hashes=True), with_globalid=True)
    return rows.drop("globalid")


def feed_copy_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The copy text read back, so that quoting shows and numbers compare as numbers."""
    texts = feed.copy_line(feed.to_copy_rows(good_feed(spark, sf, hashes=True)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.COPY16)
    read = texts.select(F.inline(F.array(F.from_csv("copy_line", schema, {"escape": '"'}))))
    return read.withColumn("id", F.length("id"))


def feed_stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    return good_feed(spark, sf).select("event_id", stable_uuid("event_id").alias("id"))


def feed_long_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = long_lines_of(events(spark, sf).drop("props"))
    parsed = feed.parse_feed(lines, hashes=True)
    return parsed.select("event_id", "orig", "latitude", "flattrihash", "reject_reason")


def feed_ingest_time(spark: SparkSession, sf: str) -> DataFrame:
    """Rows stamped with the time of the query: one time, not before the query was made."""
    made = F.timestamp_micros(F.lit(time.time_ns() // 1000))
    rows = feed.to_planes12(good_feed(spark, sf, id_type="bigint"), ts_mode="ingest")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("ts").alias("n_ts"),
        F.count_if((F.col("ts") >= made) & (F.col("ts") <= F.current_timestamp())).alias("n_within"),
    )


def feed_copy_files(spark: SparkSession, sf: str) -> DataFrame:
    """Copy text written as text files, ready for a server's own loader, and read back."""
    path = new_work_folder(spark, "copy")
    texts = feed.copy_line(feed.to_copy_rows(good_feed(spark, sf, hashes=True)))
    write(texts, files(path, "text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.COPY16)
    lines = read_lines(spark, path, with_file=False)
    read = lines.select(F.inline(F.array(F.from_csv("line", schema, {"escape": '"'}))))
    return read.withColumn("id", F.length("id"))


def feed_json_docs(spark: SparkSession, sf: str) -> DataFrame:
    numbered = with_objectid(good_feed(spark, sf).select("event_id", *_BASE), ["event_id"])
    docs = feed.to_documents(numbered, extra_hashes=False)
    read = docs.select(F.inline(F.array(F.from_json("document", S.document()))))
    return read.select(
        "objectid",
        F.length("globalid").alias("globalid_length"),
        "planeid",
        "ts",
        "speed",
        "dist",
        "bearing",
        "rtid",
        "orig",
        "dest",
        F.col("secsToDep").alias("secs_to_dep"),
        "longitude",
        "latitude",
        F.col("geometry")[0].alias("geometry_lon"),
        F.col("geometry")[1].alias("geometry_lat"),
    )


def feed_json_docs_all_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_uuid(good_feed(spark, sf, hashes=True)).withColumn("objectid", F.col("event_id"))
    # All four forms in one pass over the feed, each document parsed back once.
    forms = F.array(
        *[
            F.struct(
                F.lit(h).alias("extra_hashes"),
                F.lit(a).alias("agg_field"),
                F.try_parse_json(F.to_json(feed.document_struct(h, a))).alias("document"),
            )
            for h in (False, True)
            for a in (False, True)
        ]
    )
    square = F.try_variant_get("document", "$.square", "string")
    geo_hash = F.try_variant_get("document", f"$['{S.DOCUMENT_AGG_FIELD}']", "array<double>")
    return (
        rows.select(F.inline(forms))
        .groupBy("extra_hashes", "agg_field")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(square).alias("n_square"),
            F.count(geo_hash).alias("n_geo_hash"),
            F.count("document").alias("n_valid"),
        )
    )


def json_lines_validate(spark: SparkSession, sf: str) -> DataFrame:
    # Whole table; every 53rd document is cut short to have broken ones.
    cut = F.expr("if(event_id % 53 = 0, substr(props, 1, length(props) - 1), props)")
    lines = table(spark, sf, "events").select(cut.alias("line"))
    return feed.json_lines(lines).agg(
        F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid")
    )


def json_pass_through(spark: SparkSession, sf: str) -> DataFrame:
    """Objects whole with their known fields, everything else rejected with a reason."""
    forms = F.expr("""CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('[', props, ']')
        WHEN 2 THEN cast(event_id as string) WHEN 3 THEN concat('{"k":1,"k":', event_id, ',"more":[{}]}')
        ELSE substr(props, 1, length(props) - 1) END""")
    lines = table(spark, sf, "events").select("event_id", forms.alias("line"))
    schema = T.StructType([T.StructField("k", T.LongType())])
    kept = feed.documents_from_json(lines, schema).select(
        F.lit("document").alias("outcome"), F.md5("document").alias("digest"), "k"
    )
    gone = feed.rejected_documents(lines).select(
        F.col("reject_reason").alias("outcome"), F.md5("line").alias("digest"), F.lit(None).cast("long").alias("k")
    )
    return kept.union(gone)


def json_lines_to_columns(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "events").select(F.col("props").alias("line"))
    docs = feed.documents_from_json(lines, T.StructType([T.StructField("k", T.IntegerType())]))
    return docs.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def search_lines_total(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_lines(document_lines(spark, sf, "doc_id"), SEARCH_TEXT)


def search_lines_by_file(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("file"))
    return search.search_lines_by_file(document_lines(spark, sf, "doc_id"), SEARCH_TEXT, files)


def count_lines_total(spark: SparkSession, sf: str) -> DataFrame:
    return search.count_lines(document_lines(spark, sf, "doc_id"))


def select_objects_regex(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").filter(full_match("url", URL_REGEX)).select("page_id", "url")


def count_lines_matching_objects(spark: SparkSession, sf: str) -> DataFrame:
    lines = document_lines(spark, sf, "source").filter(full_match("file", SOURCE_REGEX))
    return search.count_lines_by_file(lines)


def files_search_by_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Matches per file, files without a match included, added up by folder."""
    path = document_files(spark, sf)
    lines = read_lines(spark, path, recursive=True, options=LINE_END)
    found = search.search_lines_by_file(lines, SEARCH_TEXT, list_files(spark, path, recursive=True))
    return found.groupBy(_source("file")).agg(F.sum("n_matching").alias("n_matching"))


def files_count_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the files whose keys match; other files are not opened."""
    regex = rf"source=(?:{SOURCE_REGEX})/.*"
    lines = read_lines(spark, document_files(spark, sf), regex, recursive=True, options=LINE_END)
    by_file = search.count_lines_by_file(lines)
    return by_file.groupBy(_source("file")).agg(F.sum("n_lines").alias("n_lines"))


def files_count_total(spark: SparkSession, sf: str) -> DataFrame:
    lines = read_lines(
        spark, document_files(spark, sf) + "/source=*", options=LINE_END, with_file=False
    )
    return search.count_lines(lines)


def files_listed(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's file is listed without reading it, with its length, those of no text too."""
    path = new_work_folder(spark, "files")
    pieces = table(spark, sf, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    pieces.select("source", F.expr("doc_id % 10").alias("digit"), "text").write.partitionBy("source", "digit").option(
        "lineSep", "\n"
    ).text(path)
    listed = list_objects(spark, path, r"source=.*\.txt", recursive=True)
    digit = F.regexp_extract("file", "/digit=([0-9]+)/", 1).cast("int").alias("digit")
    return listed.groupBy(_source("file"), digit).agg(F.sum("length").alias("bytes"))


#: The document files end their lines with this alone.
LINE_END = {"lineSep": "\n"}


def _source(file: str):
    return F.regexp_extract(file, "^source=([^/]*)/", 1).alias("source")


def topic_batch_counts(spark: SparkSession, sf: str) -> DataFrame:
    # Micro-batches of one minute, of which many are empty.
    rows = good_feed(spark, sf).select(
        chunk_number(F.timestamp_millis("ts"), MINUTE_US).alias("batch")
    )
    return counts.batch_report(rows, ts_of_batch=f"batch * {MINUTE_US // 1000}")


def topic_running_total(spark: SparkSession, sf: str) -> DataFrame:
    messages = events(spark, sf).select(
        F.col("props").alias("value"), chunk_number("ts", MINUTE_US).alias("batch")
    )
    counted = counts.batch_counts(messages, "batch")
    first, last = messages.agg(F.min("batch"), F.max("batch")).first()
    if first is not None:
        counted = counts.with_empty_batches(counted, first, last)
    return counts.running_total(counted)


def union_topics(spark: SparkSession, sf: str) -> DataFrame:
    source = table(spark, sf, "events").select("event_id", "event_type", "value")
    # Three topics that hold every event between them.
    topics = [
        source.filter("event_type = 'click'"),
        source.filter("event_type = 'view'"),
        source.filter("event_type IS NULL OR event_type NOT IN ('click', 'view')"),
    ]
    return (
        relay.union_streams(topics)
        .groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("event_id").alias("sum_event_id"),
            F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("sum_value_cents"),
        )
    )


def split_topic_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.posexplode(split_list("text")).alias("pos", "item")
    )


def first_of_list_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", first_of_list("text").alias("first"))


def replay_n_times(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "events").select("event_id", F.col("props").alias("line"))
    return relay.replay(lines, 3).drop("key")


def relay_key_value(spark: SparkSession, sf: str) -> DataFrame:
    messages = table(spark, sf, "events").select(
        F.col("event_id").alias("key"), F.col("props").alias("value")
    )
    return relay.relay_messages(messages)


def load_rows_by_partition(spark: SparkSession, sf: str) -> DataFrame:
    path = new_work_folder(spark, "load")
    rows = table(spark, sf, "events").withColumn("partition", F.pmod("event_id", F.lit(8)))
    tables.append(rows, path, partition_by=["partition"])
    return counts.load_report(spark, path, ["partition"])


def load_rows_by_task(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each write task of a load of copy text, told by the tasks themselves."""
    path = new_work_folder(spark, "load")
    texts = feed.copy_line(feed.to_copy_rows(good_feed(spark, sf, hashes=True)))
    report = counts.load_metrics(spark, lambda: write(texts, files(path, "text")))
    stored = counts.load_report(spark, path, fmt="text").withColumnRenamed("rows", "stored")
    both = report.join(stored, "task", "full")
    return both.agg(
        F.sum("rows").alias("rows"),
        F.sum("stored").alias("stored"),
        F.coalesce(F.bool_and((F.col("rows") == F.col("stored")) & (F.col("seconds") >= 0)), F.lit(False)).alias("equal"),
    )


def recreate_then_append(spark: SparkSession, sf: str) -> DataFrame:
    path = new_work_folder(spark, "recreate")
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "props")
    tables.append(rows, path, recreate_first=True)
    tables.append(rows, path, recreate_first=True)
    tables.append(rows, path)
    return (
        spark.read.parquet(path)
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("sum_event_id"))
    )


def upsert_latest_by_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("ts", F.unix_millis("ts"))
    return keyed.latest_by_key(rows, ["user_id", "event_type"], "event_id")


def keyed_table_read(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches appended to a keyed table; the second holds newer rows of all its keys."""
    path = new_work_folder(spark, "keyed")
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "props")
    tables.write_batch_once(rows, 0, path)
    views = rows.filter("event_type = 'view'").withColumn("props", F.lit("{}"))
    tables.write_batch_once(views, 1, path)
    arrival = F.struct("batch_id", "event_id")
    return tables.read_keyed(spark, path, ["user_id", "event_type"], arrival).select(
        "user_id", "event_type", "event_id", "props"
    )


def upsert_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that arrived together, or with no time at all: some real row of each key wins,
    and the same one however the rows are dealt out."""
    rows = events(spark, sf).select("user_id", "event_id", "event_type", "props")
    rows = rows.withColumn("arrival", F.when(F.col("user_id") % 2 == 0, F.lit(1)))
    one = keyed.latest_by_key(rows, ["user_id"], "arrival")
    other = keyed.latest_by_key(rows.repartition(5, "event_id"), ["user_id"], "arrival")
    both = one.join(other.select("user_id", F.col("event_id").alias("other")), "user_id")
    real = both.join(rows.select("user_id", "event_id", "props"), ["user_id", "event_id", "props"])
    return real.agg(
        F.count(F.lit(1)).alias("n_real"), F.count_if(F.col("event_id") == F.col("other")).alias("n_same")
    )


def keyed_table_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """A keyed table of two batches put together, with a third batch after it."""
    path, target = new_work_folder(spark, "keyed"), new_work_folder(spark, "compacted")
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "props")
    keys, arrival = ["user_id", "event_type"], F.struct("batch_id", "event_id")
    tables.write_batch_once(rows, 0, path)
    tables.write_batch_once(rows.filter("event_type = 'view'").withColumn("props", F.lit("{}")), 1, path)
    tables.compact_keyed(spark, path, target, keys, arrival, through=1)
    later = rows.filter("event_type = 'click'").withColumn("props", F.lit("[]"))
    tables.write_batch_once(later, 2, target)
    return tables.read_keyed(spark, target, keys, arrival).drop("batch_id")


def keyed_table_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Six batches into a bucketed table whose levels are merged as they fill."""
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "props")
    stored = KeyedTable(spark, new_work_folder(spark, "keyed"), rows.schema, ("user_id", "event_type"), "event_id", buckets=8)
    for part in range(PARTS):
        stored.add(rows.where(F.pmod("event_id", F.lit(PARTS)) == part))
        stored.compact(fan=3)
    return stored.current()


def _windows(spark: SparkSession, sf: str) -> tuple[WindowTable, datetime]:
    """Events written in six batches into windows of a day, and the newest time."""
    rows = events(spark, sf).select("event_id", "event_type", "ts")
    stored = WindowTable(spark, new_work_folder(spark, "windows"), rows.schema, DAY_US)
    for part in range(PARTS):
        stored.append(rows.where(F.pmod("event_id", F.lit(PARTS)) == part), part, written="ts")
    return stored, rows.agg(F.max("ts")).first()[0]


def window_table_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that are over lie in one folder; the newest stays as its batches left it."""
    stored, as_of = _windows(spark, sf)
    stored.append(events(spark, sf), PARTS - 1)  # a repeated batch
    stored.compact(as_of)
    stored.clean()
    folders = [(w, len(f)) for w, f in stored.listed().folders.items()]
    counted = spark.createDataFrame(folders, "window long, n_folders int")
    rows = stored.read().groupBy(chunk_number("written", DAY_US).alias("window"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("sum_event_id")).join(counted, "window")


def window_table_expired(spark: SparkSession, sf: str) -> DataFrame:
    """What a week's retention leaves after the files of older windows are gone."""
    stored, as_of = _windows(spark, sf)
    stored.compact(as_of)
    stored.expire(as_of, TTL_SECONDS)
    stored.clean()
    return stored.read().select("event_id", "event_type", F.unix_micros("written").alias("written_us"))


def cluster_by_id_ts_desc(spark: SparkSession, sf: str) -> DataFrame:
    """Write clustered, then read the place of each row within its user off the files."""
    path = new_work_folder(spark, "clustered")
    rows = events(spark, sf).select("user_id", "ts", "event_id")
    tables.write_clustered(rows, path, "user_id", "ts", ["event_id"])
    stored = spark.read.parquet(path).select(
        "user_id",
        "event_id",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    # One row per user and file, so even a very frequent user is a short list here.
    runs = stored.groupBy("user_id", "file").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row")
    )
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("int")
    earlier = (
        Window.partitionBy("user_id").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    rank = F.col("before") + F.col("row") - F.col("first_row") + 1
    return stored.join(runs, ["user_id", "file"]).select(
        "user_id", "event_id", rank.alias("newest_rank")
    )


def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    chunks = F.array(
        *[
            F.struct(F.lit(us).cast("bigint").alias("interval_us"),
                     chunk_number("ts", us).alias("chunk"))
            for us in (WEEK_US, HOUR_US)
        ]
    )
    return (
        events(spark, sf)
        .select(F.inline(chunks))
        .groupBy("interval_us", "chunk")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def chunked_range_read(spark: SparkSession, sf: str) -> DataFrame:
    path = new_work_folder(spark, "chunked")
    tables.write_chunked(events(spark, sf).select("event_id", "ts"), path, "ts")
    since, until = (t.replace(tzinfo=timezone.utc) for t in RANGE)
    kept = keyed.in_time_range(spark.read.parquet(path), "ts", since, until)
    return kept.select("event_id", F.unix_micros("ts").alias("ts_us"))


def ttl_retention(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf)
    as_of = rows.agg(F.max("ts")).first()[0]
    kept = keyed.retained(rows, "ts", as_of, TTL_SECONDS)
    return kept.select("event_id", F.unix_micros("ts").alias("ts_us"))


QUERIES: dict[str, Query] = {
    "feed_parse_typed": feed_parse_typed,
    "feed_rejects": feed_rejects,
    "feed_id_event_time": feed_id_event_time,
    "feed_uuid_ids": feed_uuid_ids,
    "feed_wkt_point": feed_wkt_point,
    "feed_hash_fields": feed_hash_fields,
    "feed_global_ids": feed_global_ids,
    "feed_copy_rows": feed_copy_rows,
    "feed_copy_rows_global": feed_copy_rows_global,
    "feed_copy_lines": feed_copy_lines,
    "feed_stable_ids": feed_stable_ids,
    "feed_json_docs": feed_json_docs,
    "feed_json_docs_all_flags": feed_json_docs_all_flags,
    "json_lines_validate": json_lines_validate,
    "json_lines_to_columns": json_lines_to_columns,
    "search_lines_total": search_lines_total,
    "search_lines_by_file": search_lines_by_file,
    "count_lines_total": count_lines_total,
    "select_objects_regex": select_objects_regex,
    "count_lines_matching_objects": count_lines_matching_objects,
    "topic_batch_counts": topic_batch_counts,
    "topic_running_total": topic_running_total,
    "union_topics": union_topics,
    "split_topic_list": split_topic_list,
    "first_of_list": first_of_list_query,
    "replay_n_times": replay_n_times,
    "relay_key_value": relay_key_value,
    "load_rows_by_partition": load_rows_by_partition,
    "recreate_then_append": recreate_then_append,
    "upsert_latest_by_key": upsert_latest_by_key,
    "keyed_table_read": keyed_table_read,
    "cluster_by_id_ts_desc": cluster_by_id_ts_desc,
    "chunk_counts": chunk_counts,
    "chunked_range_read": chunked_range_read,
    "ttl_retention": ttl_retention,
    **STREAM_QUERIES,
    "feed_long_lines": feed_long_lines,
    "feed_ingest_time": feed_ingest_time,
    "feed_copy_files": feed_copy_files,
    "json_pass_through": json_pass_through,
    "load_rows_by_task": load_rows_by_task,
    "files_search_by_folder": files_search_by_folder,
    "files_count_matching": files_count_matching,
    "files_count_total": files_count_total,
    "files_listed": files_listed,
    "upsert_with_ties": upsert_with_ties,
    "keyed_table_compacted": keyed_table_compacted,
    "keyed_table_levels": keyed_table_levels,
    "window_table_compacted": window_table_compacted,
    "window_table_expired": window_table_expired,
}
