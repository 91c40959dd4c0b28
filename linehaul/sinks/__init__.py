from .keyed_tables import KeyedTable
from .tables import (
    append,
    conform,
    read_keyed,
    recreate,
    write_batch_once,
    write_chunked,
    write_clustered,
)
from .targets import Target, cassandra, elasticsearch, files, postgres, topic, write, writer_to
from .window_tables import WindowTable

__all__ = [
    "KeyedTable",
    "Target",
    "WindowTable",
    "append",
    "cassandra",
    "conform",
    "elasticsearch",
    "files",
    "postgres",
    "read_keyed",
    "recreate",
    "topic",
    "write",
    "write_batch_once",
    "write_chunked",
    "write_clustered",
    "writer_to",
]
