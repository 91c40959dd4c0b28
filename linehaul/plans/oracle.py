"""The registered queries once more as SQL, computed from the table columns directly.

None of these builds or parses a feed line: they state what a well-formed line
of an event must come out as.
"""

from __future__ import annotations

from linehaul.functions.times import MINUTE_US, WEEK_US
from linehaul.plans.inputs import PARTS
from linehaul.plans.queries import (
    DAY_US,
    HOUR_US,
    RANGE,
    SEARCH_TEXT,
    SOURCE_REGEX,
    TTL_SECONDS,
    URL_REGEX,
)

_FEED = """
WITH tokens AS (
  SELECT *, lpad(CAST(event_id * 37 % 100000 AS VARCHAR), 5, '0') AS frac FROM events
), feed AS (
  SELECT event_id,
    CAST(user_id AS VARCHAR) AS planeid,
    epoch_us(ts) // 1000 AS ts,
    value AS speed,
    CAST(event_id % 1000 AS DOUBLE) AS dist,
    CAST(event_id % 360 - 180 AS DOUBLE) AS bearing,
    CAST(event_id % 50 AS INTEGER) AS rtid,
    event_type || CASE WHEN event_id % 7 = 0 THEN ' "X"' ELSE '' END
      || ' Airport, ' || CAST(user_id % 9 AS VARCHAR) AS orig,
    'Dest Airport' AS dest,
    -1 AS secstodep,
    CAST(event_id % 360 - 180 AS VARCHAR) || '.' || frac AS lon_token,
    CAST(event_id % 180 - 90 AS VARCHAR) || '.' || frac AS lat_token,
    CAST(CAST(event_id % 360 - 180 AS VARCHAR) || '.' || frac AS DOUBLE) AS longitude,
    CAST(CAST(event_id % 180 - 90 AS VARCHAR) || '.' || frac AS DOUBLE) AS latitude,
    'g' || frac AS geohash, 's' || frac AS sqrhash,
    'p' || frac AS pntytrihash, 'f' || frac AS flattrihash,
    CASE WHEN event_id % 101 = 0 THEN 'too_few_fields'
         WHEN event_id % 97 = 0 THEN 'bad_ts' END AS reject_reason
  FROM tokens
), good AS (SELECT * FROM feed WHERE reject_reason IS NULL)
"""
_WKT = "'POINT (' || lon_token || ' ' || lat_token || ')'"
_BASE = "planeid, ts, speed, dist, bearing, rtid, orig, dest, secstodep, longitude, latitude"
_TABLE_BASE = (
    "ts, speed, dist, bearing, rtid, orig, dest, secstodep, longitude AS lon, latitude AS lat"
)

_LINES = r"""
WITH parts AS (
  SELECT doc_id, source, regexp_split_to_array(text, '\r\n|\r|\n') AS p FROM documents
), doc_lines AS (
  SELECT doc_id, source,
    CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS lines FROM parts
), lines AS (SELECT doc_id, source, unnest(lines) AS line FROM doc_lines)
"""


def _flags(hashes: bool, agg: bool) -> str:
    return f"""SELECT {hashes} AS extra_hashes, {agg} AS agg_field, count(*) AS n,
      {"count(*)" if hashes else "CAST(0 AS BIGINT)"} AS n_square,
      {"count(*)" if agg else "CAST(0 AS BIGINT)"} AS n_geo_hash,
      count(*) AS n_valid FROM good"""


# Files end every document with a line end of its own.
_FILE_LINES = """
WITH lines AS (
  SELECT source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
"""

_REPORT = f"""{_FEED}
SELECT batch_id, n AS count, CAST(sum(n) OVER (ORDER BY batch_id) AS BIGINT) AS total
FROM (SELECT event_id % {PARTS} AS batch_id, count(*) AS n FROM good GROUP BY 1)"""

ORACLE: dict[str, str] = {
    "feed_parse_typed": f"{_FEED} SELECT event_id, {_BASE} FROM good",
    "feed_rejects": f"""{_FEED}
SELECT event_id, reject_reason FROM feed WHERE reject_reason IS NOT NULL""",
    "feed_id_event_time": f"""{_FEED}
SELECT CAST(planeid AS BIGINT) AS id, {_TABLE_BASE}, {_WKT} AS geometry FROM good""",
    "feed_uuid_ids": f"""{_FEED}
SELECT count(*) AS n, count(*) AS n_ids, count(*) AS n_full_length FROM good""",
    "feed_wkt_point": f"{_FEED} SELECT event_id, {_WKT} AS geometry FROM good",
    "feed_hash_fields": f"""{_FEED}
SELECT {_TABLE_BASE}, {_WKT} AS geometry, geohash, sqrhash, pntytrihash, flattrihash FROM good""",
    "feed_global_ids": f"""{_FEED}
SELECT row_number() OVER (ORDER BY event_id) AS objectid, planeid AS plane_id, {_TABLE_BASE},
  geohash AS esri_geohash_geohash_4326_12, sqrhash AS esri_geohash_square_102100_30,
  pntytrihash AS esri_geohash_pointytriangle_102100_30,
  flattrihash AS esri_geohash_flattriangle_102100_30,
  longitude AS point_lon, latitude AS point_lat FROM good""",
    "feed_copy_rows": f"""{_FEED}
SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d %H:%M:%S.%g') AS ts, speed, dist, bearing,
  rtid, orig, dest, secstodep, longitude AS lon, latitude AS lat,
  geohash, sqrhash, pntytrihash, flattrihash, 'SRID=4326;' || {_WKT} AS geometry FROM good""",
    "feed_copy_rows_global": f"""{_FEED}
SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d %H:%M:%S.%g') AS ts, speed, dist, bearing,
  rtid, orig, dest, secstodep, longitude, latitude,
  geohash AS esri_geohash_geohash_4326_12, sqrhash AS esri_geohash_square_102100_26,
  pntytrihash AS esri_geohash_pointytriangle_102100_26,
  flattrihash AS esri_geohash_flattriangle_102100_26,
  'SRID=4326;' || {_WKT} AS geometry FROM good""",
    "feed_copy_lines": f"""{_FEED}
SELECT 36 AS id, strftime(make_timestamp(ts * 1000), '%Y-%m-%d %H:%M:%S.%g') AS ts,
  speed, dist, bearing, rtid, orig, dest, secstodep, longitude AS lon, latitude AS lat,
  geohash, sqrhash, pntytrihash, flattrihash, 'SRID=4326;' || {_WKT} AS geometry FROM good""",
    "feed_stable_ids": f"""{_FEED}, digests AS (
  SELECT event_id, md5('{{"event_id":' || CAST(event_id AS VARCHAR) || '}}') AS h FROM good)
SELECT event_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]
  AS id FROM digests""",
    "feed_json_docs": f"""{_FEED}
SELECT row_number() OVER (ORDER BY event_id) AS objectid, 36 AS globalid_length, planeid, ts,
  speed, dist, bearing, rtid, orig, dest, secstodep AS secs_to_dep, longitude, latitude,
  longitude AS geometry_lon, latitude AS geometry_lat FROM good""",
    "feed_json_docs_all_flags": _FEED
    + " UNION ALL ".join(_flags(h, a) for h in (False, True) for a in (False, True)),
    "json_lines_validate": """
WITH lines AS (
  SELECT CASE WHEN event_id % 53 = 0 THEN left(props, length(props) - 1) ELSE props END AS line
  FROM events)
SELECT count(*) FILTER (json_valid(line)) AS n_valid,
  count(*) FILTER (NOT json_valid(line)) AS n_invalid FROM lines""",
    "json_lines_to_columns": """
SELECT CAST(props ->> '$.k' AS INTEGER) AS k, count(*) AS n FROM events
WHERE json_valid(props) GROUP BY 1""",
    "search_lines_total": f"""{_LINES}
SELECT count(*) FILTER (contains(line, '{SEARCH_TEXT}')) AS n_matching FROM lines""",
    "search_lines_by_file": f"""{_LINES}
SELECT doc_id AS file,
  CAST(len(list_filter(lines, lambda x: contains(x, '{SEARCH_TEXT}'))) AS BIGINT) AS n_matching
FROM doc_lines""",
    "count_lines_total": f"{_LINES} SELECT count(*) AS n_lines FROM lines",
    "select_objects_regex": f"""
SELECT page_id, url FROM pages WHERE regexp_full_match(url, '{URL_REGEX}')""",
    "count_lines_matching_objects": f"""{_LINES}
SELECT source AS file, count(*) AS n_lines FROM lines
WHERE regexp_full_match(source, '{SOURCE_REGEX}') GROUP BY source""",
    "topic_batch_counts": f"""{_FEED}, batches AS (
  SELECT ts * 1000 // {MINUTE_US} AS batch, count(*) AS n FROM good GROUP BY 1)
SELECT batch * {MINUTE_US // 1000} AS ts, n AS "count",
  CAST(sum(n) OVER (ORDER BY batch) AS BIGINT) AS total FROM batches""",
    "topic_running_total": f"""
WITH batches AS (
  SELECT epoch_us(ts) // {MINUTE_US} AS batch, count(*) AS n FROM events GROUP BY 1
), spine AS (
  SELECT unnest(generate_series(min(batch), max(batch))) AS batch FROM batches)
SELECT s.batch, coalesce(b.n, 0) AS "count",
  CAST(sum(coalesce(b.n, 0)) OVER (ORDER BY s.batch) AS BIGINT) AS total
FROM spine s LEFT JOIN batches b ON s.batch = b.batch""",
    "union_topics": """
SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS sum_event_id,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS sum_value_cents
FROM events GROUP BY event_type""",
    "split_topic_list": r"""
WITH items AS (
  SELECT doc_id, string_split(regexp_replace(text, ',+\z', ''), ',') AS items FROM documents
  WHERE NOT regexp_full_match(text, ',+'))
SELECT doc_id, CAST(unnest(range(len(items))) AS INTEGER) AS pos, unnest(items) AS item
FROM items""",
    "first_of_list": "SELECT doc_id, split_part(text, ',', 1) AS first FROM documents",
    "replay_n_times": """
SELECT event_id, CAST(c.copy AS INTEGER) AS copy, props AS value
FROM events CROSS JOIN (SELECT unnest(range(1, 4)) AS copy) c""",
    "relay_key_value": "SELECT CAST(event_id AS VARCHAR) AS key, props AS value FROM events",
    "load_rows_by_partition": """
SELECT CAST(event_id % 8 AS INTEGER) AS partition, count(*) AS rows FROM events GROUP BY 1""",
    "recreate_then_append": """
SELECT event_type, 2 * count(*) AS n, CAST(2 * sum(event_id) AS BIGINT) AS sum_event_id
FROM events GROUP BY event_type""",
    "upsert_latest_by_key": """
SELECT event_id, epoch_us(ts) // 1000 AS ts, user_id, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""",
    "keyed_table_read": """
SELECT user_id, event_type, event_id,
  CASE WHEN event_type = 'view' THEN '{}' ELSE props END AS props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""",
    "cluster_by_id_ts_desc": """
SELECT user_id, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS newest_rank
FROM events""",
    "chunk_counts": f"""
SELECT CAST({WEEK_US} AS BIGINT) AS interval_us, epoch_us(ts) // {WEEK_US} AS chunk,
  count(*) AS n FROM events GROUP BY 2
UNION ALL
SELECT CAST({HOUR_US} AS BIGINT), epoch_us(ts) // {HOUR_US}, count(*) FROM events GROUP BY 2""",
    "chunked_range_read": f"""
SELECT event_id, epoch_us(ts) AS ts_us FROM events
WHERE ts >= TIMESTAMP '{RANGE[0]}' AND ts < TIMESTAMP '{RANGE[1]}'""",
    "ttl_retention": f"""
SELECT event_id, epoch_us(ts) AS ts_us FROM events
WHERE epoch_us(ts) > (SELECT max(epoch_us(ts)) FROM events) - CAST({TTL_SECONDS} AS BIGINT) * 1000000""",
    "stream_ingest": f"""{_FEED}
SELECT event_id, CAST(planeid AS BIGINT) AS planeid, {_BASE.removeprefix("planeid, ")} FROM good""",
    "stream_batch_report": _REPORT,
    "stream_listener_report": _REPORT,
    "stream_planes16": f"""{_FEED}
SELECT {_TABLE_BASE}, {_WKT} AS geometry, geohash, sqrhash, pntytrihash, flattrihash FROM good""",
    "stream_planes18": f"""{_FEED}
SELECT row_number() OVER (ORDER BY event_id % {PARTS}, event_id) AS objectid, event_id % {PARTS} AS batch_id,
  ts, speed, longitude AS lon, latitude AS lat FROM good""",
    "stream_documents": f"""{_FEED}
SELECT row_number() OVER (ORDER BY event_id % {PARTS}, event_id) AS objectid, planeid, ts, speed, orig, longitude, latitude
FROM good""",
    "stream_processing_time": f"""{_FEED}
SELECT event_id % {PARTS} AS batch_id, count(*) AS n, CAST(sum(ts) AS BIGINT) AS sum_ts FROM good GROUP BY 1""",
    "stream_dropped_batch": f"""
SELECT event_id % {PARTS} AS batch_id, CASE WHEN event_id % {PARTS} <> 2 THEN count(*) END AS n_kept,
  CASE WHEN event_id % {PARTS} <> 2 THEN count(*) END AS n_counted,
  CASE WHEN event_id % {PARTS} = 2 THEN 'target is gone' END AS error
FROM events GROUP BY event_id % {PARTS}""",
    "stream_repeated_batch": f"SELECT event_id % {PARTS} AS batch_id, event_id, event_type FROM events",
    "stream_running_total": f"""
SELECT batch_id, CAST(sum(n) OVER (ORDER BY batch_id) AS BIGINT) AS total
FROM (SELECT event_id % {PARTS} AS batch_id, count(*) FILTER (event_id % {PARTS} <> 3) AS n FROM events GROUP BY 1)""",
    "stream_union_topics": "SELECT event_id, event_type, value FROM events",
    "stream_relay": "SELECT CAST(event_id AS VARCHAR) AS key, props AS value FROM events",
    "stream_start_positions": f"""
SELECT start, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS sum_event_id
FROM events, (VALUES ('earliest', 0), ('latest', 2)) AS s(start, first)
WHERE event_id % {PARTS} >= first GROUP BY start, event_type""",
    "feed_long_lines": f"""{_FEED}
SELECT event_id, '"a,b"x ' || event_type AS orig, latitude, 'f' || frac AS flattrihash,
  CASE WHEN event_id % 97 = 0 THEN 'bad_ts' END AS reject_reason
FROM tokens JOIN (SELECT event_id, latitude FROM feed) USING (event_id)""",
    "feed_ingest_time": f"""{_FEED}
SELECT count(*) AS n, CAST(1 AS BIGINT) AS n_ts, count(*) AS n_within FROM good""",
    "feed_copy_files": f"""{_FEED}
SELECT 36 AS id, strftime(make_timestamp(ts * 1000), '%Y-%m-%d %H:%M:%S.%g') AS ts,
  speed, dist, bearing, rtid, orig, dest, secstodep, longitude AS lon, latitude AS lat,
  geohash, sqrhash, pntytrihash, flattrihash, 'SRID=4326;' || {_WKT} AS geometry FROM good""",
    "json_pass_through": """
SELECT CASE event_id % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'not_an_object' WHEN 2 THEN 'not_an_object'
    WHEN 3 THEN 'document' ELSE 'not_json' END AS outcome,
  md5(CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '[' || props || ']' WHEN 2 THEN CAST(event_id AS VARCHAR)
    WHEN 3 THEN '{"k":1,"k":' || event_id || ',"more":[{}]}' ELSE left(props, length(props) - 1) END) AS digest,
  CASE event_id % 5 WHEN 0 THEN CAST(props ->> '$.k' AS BIGINT) WHEN 3 THEN event_id END AS k
FROM events""",
    "load_rows_by_task": f"""{_FEED}
SELECT count(*) AS rows, count(*) AS stored, true AS equal FROM good""",
    "files_search_by_folder": f"""{_FILE_LINES}
SELECT source, count(*) FILTER (contains(line, '{SEARCH_TEXT}')) AS n_matching FROM lines GROUP BY source""",
    "files_count_matching": f"""{_FILE_LINES}
SELECT source, count(*) AS n_lines FROM lines
WHERE regexp_full_match(source, '{SOURCE_REGEX}') GROUP BY source""",
    "files_count_total": f"{_FILE_LINES} SELECT count(*) AS n_lines FROM lines",
    "files_listed": """
SELECT source, CAST(doc_id % 10 AS INTEGER) AS digit, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes
FROM documents GROUP BY 1, 2""",
    "upsert_with_ties": """
SELECT count(DISTINCT user_id) AS n_real, count(DISTINCT user_id) AS n_same FROM events""",
    "keyed_table_levels": """
SELECT user_id, event_type, event_id, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""",
    "window_table_compacted": f"""
SELECT epoch_us(ts) // {DAY_US} AS "window", count(*) AS n, CAST(sum(event_id) AS BIGINT) AS sum_event_id,
  CAST(CASE WHEN epoch_us(ts) // {DAY_US} < (SELECT max(epoch_us(ts)) // {DAY_US} FROM events) THEN 1
    ELSE count(DISTINCT event_id % {PARTS}) END AS INTEGER) AS n_folders
FROM events GROUP BY 1""",
    "window_table_expired": f"""
SELECT event_id, event_type, epoch_us(ts) AS written_us FROM events
WHERE epoch_us(ts) > (SELECT max(epoch_us(ts)) FROM events) - CAST({TTL_SECONDS} AS BIGINT) * 1000000""",
    "keyed_table_compacted": """
SELECT user_id, event_type, event_id,
  CASE event_type WHEN 'view' THEN '{}' WHEN 'click' THEN '[]' ELSE props END AS props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""",
}
