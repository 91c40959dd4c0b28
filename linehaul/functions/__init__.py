from .geo import ewkt_point, geo_array, point_struct, wkt_point
from .ids import stable_uuid, with_objectid, with_uuid
from .text import first_of_list, split_lines, split_list
from .times import chunk_number, format_epoch_ms

__all__ = [
    "chunk_number",
    "ewkt_point",
    "first_of_list",
    "format_epoch_ms",
    "geo_array",
    "point_struct",
    "split_lines",
    "split_list",
    "stable_uuid",
    "with_objectid",
    "with_uuid",
    "wkt_point",
]
