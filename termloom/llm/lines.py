"""Lines of texts as columns: splitting, normal form and hash, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_lines(text: Column) -> Column:
    """The lines of a text; a null text has none, an empty one has one blank line."""
    return F.split(text, "\n")


def normal_line(line: Column) -> Column:
    """Lower case, runs of ASCII white space as one blank, ends trimmed."""
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def line_hashes(text: Column) -> Column:
    """The distinct hashes of the lines that aren't blank."""
    lines = F.filter(F.transform(split_lines(text), normal_line), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def keep_lines(text: Column, dropped: Column) -> Column:
    """The text without the lines whose hash is in dropped; blank lines stay."""
    kept = F.filter(split_lines(text), lambda x: (normal_line(x) == "") | ~F.array_contains(dropped, F.xxhash64(normal_line(x))))
    return F.when(dropped.isNull() | (F.size(dropped) == 0), text).otherwise(F.array_join(kept, "\n"))
