"""External targets as a writer format with its options.

The connectors themselves are packages of the deployment; this module names
their formats and options and passes rows on. User names and passwords are
arguments and are never stored here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Target:
    """A DataFrame writer format, its options and, where it takes one, a save path."""

    fmt: str
    options: dict[str, str] = field(default_factory=dict)
    path: str | None = None
    overwrite_options: dict[str, str] = field(default_factory=dict)
    #: Most tasks that write at a time.
    tasks: int | None = None


def _given(**options) -> dict[str, str]:
    return {k: str(v) for k, v in options.items() if v is not None}


def files(path: str, fmt: str = "json") -> Target:
    return Target(fmt, path=path)


def elasticsearch(
    nodes: str,
    index: str,
    port: int = 9200,
    user: str | None = None,
    password: str | None = None,
    auto_create: bool = True,
    wan_only: bool = False,
    id_field: str | None = None,
) -> Target:
    """Documents of an index. ``id_field`` makes repeated writes of a row land on one document."""
    options = {
        "es.nodes": nodes,
        "es.port": port,
        "es.net.http.auth.user": user,
        "es.net.http.auth.pass": password,
        "es.index.auto.create": str(auto_create).lower(),
        "es.nodes.wan.only": str(wan_only).lower(),
        "es.mapping.id": id_field,
    }
    return Target("org.elasticsearch.spark.sql", _given(**options), index)


def cassandra(
    keyspace: str,
    table: str,
    host: str | None = None,
    consistency: str = "ANY",
    concurrent_writes: int | None = None,
    batch_rows: str | None = None,
    ttl_seconds: int = -1,
) -> Target:
    """Rows of a keyed table; the store itself replaces rows of equal key."""
    options = {
        "keyspace": keyspace,
        "table": table,
        "spark.cassandra.connection.host": host,
        "spark.cassandra.output.consistency.level": consistency,
        "spark.cassandra.output.concurrent.writes": concurrent_writes,
        "spark.cassandra.output.batch.size.rows": batch_rows,
        "spark.cassandra.output.ttl": ttl_seconds if ttl_seconds >= 0 else None,
    }
    # The connector empties a table only when told so in as many words.
    confirm = {"confirm.truncate": "true"}
    return Target("org.apache.spark.sql.cassandra", _given(**options), overwrite_options=confirm)


def postgres(
    host: str,
    database: str,
    table: str,
    user: str,
    password: str,
    port: int = 5432,
    batch_rows: int = 10_000,
    connections: int | None = None,
) -> Target:
    """Rows of a relational table, sent in large multi-row inserts.

    With ``connections``, so many tasks write at a time; rows are dealt out to them
    after all else is computed, so the work before is not narrowed. Text goes
    into uuid, time and geometry columns as is; the server casts it.
    """
    options = {
        "url": f"jdbc:postgresql://{host}:{port}/{database}"
        "?reWriteBatchedInserts=true&stringtype=unspecified",
        "driver": "org.postgresql.Driver",
        "dbtable": table,
        "user": user,
        "password": password,
        "batchsize": batch_rows,
        "numPartitions": connections,
    }
    # Overwriting keeps the table definition (chunks, indexes) and drops its rows.
    return Target(
        "jdbc", _given(**options), overwrite_options={"truncate": "true"}, tasks=connections
    )


def topic(
    brokers: str,
    name: str,
    acks: str = "1",
    retries: int | None = None,
    batch_bytes: int | None = None,
    linger_ms: int | None = None,
    buffer_bytes: int | None = None,
    request_timeout_ms: int | None = None,
) -> Target:
    """Messages ``(key, value)`` to a topic; what is not given is left to the client."""
    options = {
        "kafka.bootstrap.servers": brokers,
        "topic": name,
        "kafka.acks": acks,
        "kafka.retries": retries,
        "kafka.batch.size": batch_bytes,
        "kafka.linger.ms": linger_ms,
        "kafka.buffer.memory": buffer_bytes,
        "kafka.request.timeout.ms": request_timeout_ms,
    }
    return Target("kafka", _given(**options))


def write(df: DataFrame, target: Target, recreate_first: bool = False) -> None:
    """Append rows to a target; with ``recreate_first`` they replace what it holds."""
    options = {**target.options, **(target.overwrite_options if recreate_first else {})}
    if target.tasks:
        df = df.repartition(target.tasks)
    writer = df.write.format(target.fmt).options(**options)
    writer = writer.mode("overwrite" if recreate_first else "append")
    writer.save(target.path) if target.path else writer.save()


def writer_to(target: Target) -> Callable[[DataFrame, int], None]:
    """The target as a micro-batch action for ``run_stream``."""
    return lambda batch, batch_id: write(batch, target)
