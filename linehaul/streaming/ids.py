"""Sequential ids that go on from micro-batch to micro-batch."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame

from linehaul.functions.ids import numbered_rows
from linehaul.session import list_names, read_text, remove, write_text


def with_stream_objectid(
    batch: DataFrame,
    batch_id: int,
    ledger: str,
    order_by: list[str | Column] | None = None,
    name: str = "objectid",
) -> DataFrame:
    """Number the rows of a micro-batch, going on where the batches before it ended.

    The ledger folder keeps the next free id after each batch, a small file each. A repeated batch
    looks only at earlier ones, so it starts from the same id again; with a
    unique ``order_by`` (partition and offset, say) every row gets the same id.
    """
    spark = batch.sparkSession
    kept = _batches(spark, ledger)
    earlier = [i for i in kept if i < batch_id]
    first = json.loads(read_text(spark, f"{ledger}/batch_id={earlier[-1]}"))["next_id"] if earlier else 1

    numbered, total = numbered_rows(batch, order_by, first, name)
    write_text(spark, f"{ledger}/batch_id={batch_id}", json.dumps({"next_id": first + total(), "batch_id": batch_id}))
    # No retry asks for what lies before the batch before this one.
    for old in earlier[:-1]:
        remove(spark, f"{ledger}/batch_id={old}")
    return numbered


def _batches(spark, ledger: str) -> list[int]:
    names = list_names(spark, ledger)
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch_id="))
