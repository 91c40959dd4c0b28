"""Small stand-ins for connectors that are not installed: they show what options and rows arrive."""

from __future__ import annotations

import json
import os
import sys
import uuid
from datetime import datetime

from pyspark import cloudpickle
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    SimpleDataSourceStreamReader,
    WriterCommitMessage,
)

RECORD = (
    "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"
)


def _records(folder, topics, since):
    when = datetime(2024, 1, 1)
    for name in topics.split(","):
        with open(os.path.join(folder, name)) as f:
            for i, text in enumerate(f.read().splitlines()):
                if i >= since.get(name, 0):
                    key, value = text.split("\t")
                    yield (key.encode(), value.encode(), name, 0, i, when)


def _ends(folder, topics):
    ends = {}
    for name in topics.split(","):
        with open(os.path.join(folder, name)) as f:
            ends[name] = len(f.read().splitlines())
    return ends


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.topics = options["kafka.bootstrap.servers"], options["subscribe"]
        self.start = options["startingOffsets"]

    def initialOffset(self):
        ends = _ends(self.folder, self.topics)
        return ends if self.start == "latest" else {n: 0 for n in ends}

    def read(self, start):
        return iter(list(_records(self.folder, self.topics, start))), _ends(
            self.folder, self.topics
        )

    def readBetweenOffsets(self, start, end):
        rows = _records(self.folder, self.topics, start)
        return iter([r for r in rows if r[4] < end[r[2]]])


class _Batch(DataSourceReader):
    def __init__(self, options):
        assert (options["startingOffsets"], options["endingOffsets"]) == ("earliest", "latest")
        self.folder, self.topics = options["kafka.bootstrap.servers"], options["subscribe"]

    def read(self, partition):
        yield from _records(self.folder, self.topics, {})


class TopicStandIn(DataSource):
    """A folder with one file per topic and one ``key<TAB>value`` line per message."""

    @classmethod
    def name(cls):
        return "topic_standin"

    def schema(self):
        return RECORD

    def simpleStreamReader(self, schema):
        return _Stream(self.options)

    def reader(self, schema):
        return _Batch(self.options)


class _Writer(DataSourceWriter):
    def __init__(self, out, options, overwrite):
        self.out, self.options, self.overwrite = out, options, overwrite

    def write(self, rows):
        with open(os.path.join(self.out, f"rows-{uuid.uuid4().hex}"), "w") as f:
            f.writelines(json.dumps(r.asDict(), default=str) + "\n" for r in rows)
        return WriterCommitMessage()

    def commit(self, messages):
        with open(os.path.join(self.out, "options"), "w") as f:
            json.dump({**self.options, "overwrite": self.overwrite}, f)


def sink(format_name, out):
    """A writer format of the given name that keeps rows and options below ``out``."""

    class Sink(DataSource):
        @classmethod
        def name(cls):
            return format_name

        def writer(self, schema, overwrite):
            return _Writer(out, dict(self.options), overwrite)

    return Sink


def written(out):
    rows = []
    for name in os.listdir(out):
        if name.startswith("rows-"):
            with open(os.path.join(out, name)) as f:
                rows += [json.loads(line) for line in f]
    with open(os.path.join(out, "options")) as f:
        return rows, json.load(f)


# Workers have no access to this file; send its classes along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
