"""Line-shaped computations: numbering, brace depth, blocks, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def explode_lines(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, line_number (from 1), line; lines end with CRLF, LF or CR, and a final line end gives an empty line."""
    return files.select(key, F.posexplode(F.split(content, "\r\n|\n|\r")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_number"), "line")


def brace_depths(lines: DataFrame, key: str) -> DataFrame:
    """Adds delta (opening less closing braces) and depth (after the line)."""
    count = lambda mark: F.length("line") - F.length(F.replace("line", F.lit(mark), F.lit("")))
    order = Window.partitionBy(key).orderBy("line_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("delta", (count("{") - count("}")).cast("bigint")).withColumn("depth", F.sum("delta").over(order))


def page(symbols: DataFrame, limit: int = 120) -> DataFrame:
    """The first page of each symbol's lines (at most 200) and where the next begins."""
    size = min(max(limit, 1), 200)
    last = F.least(F.col("line_end"), F.col("line_start") + size - 1).cast("int")
    return symbols.withColumn("page_end", last).withColumn("next_start_line", F.when(last < F.col("line_end"), last + 1).cast("int"))
