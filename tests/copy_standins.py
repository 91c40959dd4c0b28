"""A stand-in for a relational server's driver: a folder is the table, a file a transaction."""

from __future__ import annotations

import os
import uuid


class Connection:
    def __init__(self, dsn: str, streams: bool):
        self.folder, self.streams, self.text, self.sql = dsn, streams, b"", None

    def cursor(self):
        return Streaming(self) if self.streams else Reading(self)

    def commit(self):
        if os.path.exists(f"{self.folder}/fail") and b"bad" in self.text:
            os.remove(f"{self.folder}/fail")
            raise OSError("connection lost")
        with open(f"{self.folder}/{uuid.uuid4().hex}.csv", "wb") as f:
            f.write(self.text)
        with open(f"{self.folder}/sql", "w") as f:
            f.write(self.sql or "")

    def rollback(self):
        self.text = b""

    def close(self):
        pass


class Streaming:
    def __init__(self, connection):
        self.connection = connection

    def copy(self, sql):
        self.connection.sql = sql
        return self

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def write(self, data):
        self.connection.text += data


class Reading:
    def __init__(self, connection):
        self.connection = connection

    def copy_expert(self, sql, file):
        self.connection.sql = sql
        while block := file.read(7):
            self.connection.text += block


def streaming(dsn):
    return Connection(dsn, True)


def reading(dsn):
    return Connection(dsn, False)
