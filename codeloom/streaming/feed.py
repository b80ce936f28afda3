"""The change feed: coalescing, debounce sessions, and the streaming job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def operation(kind: Column) -> Column:
    """The change that an event stands for."""
    return F.when(kind == "signup", "create").when(kind == "error", "delete").when(kind == "purchase", "manifest").otherwise("modify")


def coalesced(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change per key and how many it stands for; an aggregation, so that a hot key is combined before it travels."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"), F.count("*").alias("n")).select(key, "last.*", "n")


def sessions(changes: DataFrame, key: str, time: str, gap_s: int) -> DataFrame:
    """Runs of changes of a key less than ``gap_s`` seconds apart, numbered in order."""
    order = Window.partitionBy(key).orderBy(time)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    opens = F.when(at - F.lag(at).over(order) < gap_s * 1_000_000, 0).otherwise(1)
    numbered = changes.select(key, time, opens.alias("opens")).withColumn("session", F.sum("opens").over(order))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(time).alias("first"))


def debounced(stream: DataFrame, key: str, time: str, gap: str = "300 milliseconds", late: str = "10 minutes") -> DataFrame:
    """A streaming DataFrame's changes in session windows, with a watermark for late ones."""
    stamped = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.session_window(time, gap).alias("window"), key).agg(F.count("*").alias("n"))


def distinct_changes(stream: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """A streaming DataFrame's changes, one per key within the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
