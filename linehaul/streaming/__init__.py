from .counting import count_batches, keep_totals, stored_report, stored_totals, topic_total
from .ids import with_stream_objectid
from .metrics import BatchMetrics
from .run import Dropped, batch_rows, run_stream, write_stream

__all__ = [
    "BatchMetrics",
    "Dropped",
    "batch_rows",
    "count_batches",
    "keep_totals",
    "run_stream",
    "stored_report",
    "stored_totals",
    "topic_total",
    "with_stream_objectid",
    "write_stream",
]
