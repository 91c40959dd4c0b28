"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.functions.text import split_lines
from linehaul.operators.feed import good_rows, parse_feed
from linehaul.session import hadoop_path, list_names, move, new_work_folder, use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts`` as an instant (the files hold it without a zone; it is UTC)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# One feed line per event. Every event gives a line: those whose number divides
# by 97 carry a broken time and those by 101 are cut after five fields, so that
# there are lines to reject.
_TOKENS = {
    "planeid": "cast(user_id as string)",
    "ts": "if(event_id % 97 = 0, 'bad', cast(unix_millis(ts) as string))",
    "speed": "cast(value as string)",
    "dist": "cast(event_id % 1000 as string)",
    "bearing": "cast(event_id % 360 - 180 as string)",
    "rtid": "cast(event_id % 50 as string)",
    "orig": """concat('"', event_type, if(event_id % 7 = 0, ' ""X""', ''),
                      ' Airport, ', cast(user_id % 9 as string), '"')""",
    "dest": """'"Dest Airport"'""",
    "secstodep": "'-1'",
    "lon": "concat(cast(event_id % 360 - 180 as string), '.', frac)",
    "lat": "concat(cast(event_id % 180 - 90 as string), '.', frac)",
    "geohash": "concat('g', frac)",
    "sqrhash": "concat('s', frac)",
    "pntytrihash": "concat('p', frac)",
    "flattrihash": "concat('f', frac)",
}
_FRAC = "lpad(cast(event_id * 37 % 100000 as string), 5, '0')"


#: Parts that a topic's messages arrive in, each a micro-batch.
PARTS = 6


class EventTopic:
    """Events as a topic: a folder into which they are delivered part by part.

    Part k holds the events whose number leaves k when divided by ``PARTS``. All
    parts are staged by one job, in as many files as it has tasks; a part arrives whole, by
    renaming its folder.
    """

    def __init__(self, rows: DataFrame, folder: str):
        self.spark, self.schema = rows.sparkSession, rows.schema
        self.staged, self.path = f"{folder}/staged", f"{folder}/topic"
        part = F.pmod("event_id", F.lit(PARTS)).alias("part")
        rows.select("*", part).write.partitionBy("part").parquet(self.staged)
        fs, p = hadoop_path(self.spark, self.path)
        fs.mkdirs(p)

    def deliver(self, part: int) -> None:
        name = f"part={part}"
        if name in list_names(self.spark, self.staged):
            move(self.spark, f"{self.staged}/{name}", f"{self.path}/{name}")

    def stream(self) -> DataFrame:
        files = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
        return files.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in files.columns else files


def document_files(spark: SparkSession, sf_dir: str) -> str:
    """All documents as text files, a folder a source; returns where they are."""
    path = new_work_folder(spark, "files")
    table(spark, sf_dir, "documents").select("source", "text").write.partitionBy("source").text(path)
    return path


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, line)``."""
    return lines_of(events(spark, sf_dir).drop("props"))


def lines_of(rows: DataFrame) -> DataFrame:
    """``(event_id, line)`` of a batch or stream of events."""
    tokens = list(_TOKENS.values())
    whole, short = (f"concat_ws(',', {', '.join(t)})" for t in (tokens, tokens[:5]))
    return rows.withColumn("frac", F.expr(_FRAC)).select(
        "event_id", F.expr(f"if(event_id % 101 = 0, {short}, {whole})").alias("line")
    )


def long_lines_of(rows: DataFrame) -> DataFrame:
    """``(event_id, line)`` with a quoted name that goes on after its quote and more fields
    than are used, up to 32,000 characters and 24,000 fields of them."""
    tokens = _TOKENS | {"orig": """concat('"a,b"x ', event_type)"""}
    more = "if(event_id % 4 = 3, repeat('m,', 24000), repeat('e', cast(event_id % 4 * 16000 as int)))"
    return rows.withColumn("frac", F.expr(_FRAC)).select(
        "event_id", F.expr(f"concat_ws(',', {', '.join(tokens.values())}, {more})").alias("line")
    )


def parsed_feed(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return parse_feed(feed_lines(spark, sf_dir), **how)


def good_feed(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return good_rows(parsed_feed(spark, sf_dir, **how))


def document_lines(spark: SparkSession, sf_dir: str, file_column: str) -> DataFrame:
    """``(file, line)`` of the documents, each document's whole text cut into lines."""
    documents = table(spark, sf_dir, "documents").select(file_column, "text")
    return documents.select(
        F.col(file_column).alias("file"), F.explode(split_lines("text")).alias("line")
    )
