"""String helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_of_list(items: str | Column) -> Column:
    """Text before the first comma; the whole text when there is none."""
    return F.substring_index(_col(items), ",", 1)


def split_list(items: str | Column) -> Column:
    """Items of a comma list. Empty items at the end are not items; an empty text is one."""
    s = _col(items)
    without_tail = F.regexp_replace(s, r",+\z", "")
    only_commas = (without_tail == "") & (s != "")
    return F.when(only_commas, F.array().cast("array<string>")).otherwise(
        F.split(without_tail, ",")
    )


def split_lines(text: str | Column) -> Column:
    r"""Lines of a text held in one column, cut as a line reader cuts a file.

    ``\n``, ``\r\n`` and ``\r`` end a line, an unterminated last line counts
    and an empty text has no line.
    """
    s = _col(text)
    # Plain replacements first: splitting at one character needs no regex engine.
    unix = F.replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.split(F.regexp_replace(unix, r"\n\z", ""), "\n")
    return F.when(s != "", lines).otherwise(F.array().cast("array<string>"))
