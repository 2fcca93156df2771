"""Lines: one row per text line of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_array(content: Column) -> Column:
    """Lines of a text, each without one trailing carriage return."""
    return F.split(F.regexp_replace(content, "\r\n|\r\\z", "\n"), "\n")


def to_lines(files: DataFrame, *keep: str) -> DataFrame:
    """Explode to (kept columns, line, text).  Row-wise: no shuffle.

    Filter ``files`` first; a filter on file columns never reaches below the
    explode by itself once the text is derived.
    """
    return files.select(*keep, F.posexplode(line_array(F.col("content"))).alias("pos", "text")).select(
        *keep, (F.col("pos") + 1).alias("line"), "text"
    )


def line_of(content: Column, needle: str) -> Column:
    """First line holding ``needle`` (case-insensitive), or 1."""
    low = F.lower(content)
    head = F.substring_index(low, needle.lower(), 1)
    breaks = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    return F.when(F.contains(low, F.lit(needle.lower())), breaks + 1).otherwise(F.lit(1))
