from .counts import (
    batch_counts,
    batch_report,
    load_report,
    load_total,
    running_total,
    with_empty_batches,
)
from .feed import (
    copy_line,
    document_struct,
    documents_from_json,
    good_rows,
    is_json_document,
    json_lines,
    json_reject_reason,
    parse_feed,
    rejected_documents,
    rejected_rows,
    to_copy_rows,
    to_documents,
    to_planes12,
    to_planes16,
    to_planes18,
)
from .keyed import clustered, in_time_range, latest_by_key, retained, with_chunk
from .relay import relay_messages, replay, union_streams
from .search import (
    contains,
    count_lines,
    count_lines_by_file,
    search_lines,
    search_lines_by_file,
)

__all__ = [
    "batch_counts",
    "batch_report",
    "clustered",
    "contains",
    "copy_line",
    "count_lines",
    "count_lines_by_file",
    "document_struct",
    "documents_from_json",
    "good_rows",
    "in_time_range",
    "is_json_document",
    "json_lines",
    "json_reject_reason",
    "latest_by_key",
    "load_report",
    "load_total",
    "parse_feed",
    "rejected_documents",
    "rejected_rows",
    "relay_messages",
    "replay",
    "retained",
    "running_total",
    "search_lines",
    "search_lines_by_file",
    "to_copy_rows",
    "to_documents",
    "to_planes12",
    "to_planes16",
    "to_planes18",
    "union_streams",
    "with_chunk",
    "with_empty_batches",
]
