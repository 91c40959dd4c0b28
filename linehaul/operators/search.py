"""Counting and searching lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(text: str, line: str = "line") -> Column:
    """Literal, case-sensitive containment; the empty text is in every line."""
    return F.col(line).contains(F.lit(text))


def count_lines(lines: DataFrame) -> DataFrame:
    """One row: ``n_lines``."""
    return lines.agg(F.count(F.lit(1)).alias("n_lines"))


def count_lines_by_file(lines: DataFrame) -> DataFrame:
    """``(file, n_lines)`` in name order."""
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines")).orderBy("file")


def search_lines(lines: DataFrame, text: str) -> DataFrame:
    """One row: ``n_matching``."""
    return lines.agg(F.count_if(contains(text)).alias("n_matching"))


def search_lines_by_file(
    lines: DataFrame, text: str, files: DataFrame | None = None
) -> DataFrame:
    """``(file, n_matching)`` in name order, files without a match included.

    ``files`` lists files that may hold no line at all (see ``list_files``);
    the lines alone cannot tell of those.
    """
    found = lines.groupBy("file").agg(F.count_if(contains(text)).alias("n_matching"))
    if files is not None:
        found = files.join(found, "file", "left").select(
            "file", F.coalesce("n_matching", F.lit(0)).alias("n_matching")
        )
    return found.orderBy("file")
