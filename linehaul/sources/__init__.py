from .lines import object_key, read_line_stream, read_lines, s3a_options
from .topics import read_topic, topic_options

__all__ = [
    "object_key",
    "read_line_stream",
    "read_lines",
    "read_topic",
    "s3a_options",
    "topic_options",
]
