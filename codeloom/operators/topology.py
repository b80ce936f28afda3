"""Environment topology: saved and detected rows as one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(saved: DataFrame, detected: DataFrame, key: str | list[str]) -> DataFrame:
    """A verified saved row stands; else the detected one does; rows of one side stay."""
    key = [key] if isinstance(key, str) else key
    names = [c for c in saved.columns if c not in key]
    a = saved.select(*key, F.struct(*names).alias("a"))
    b = detected.select(*key, F.struct(*names).alias("b"))
    keep = F.coalesce(F.col("a.status") == "VERIFIED", F.lit(False)) | F.col("b").isNull()
    return a.join(b, key, "full").select(*key, *[F.when(keep, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in names])


def is_distributed(nodes: DataFrame, most: int = 6) -> DataFrame:
    """One row: counts of nodes, hosts, services below others and dotted addresses, and whether any makes the system a distributed one.

    ``nodes`` has layer, parent and address; more than ``most`` nodes, more than
    one host, any service below another or any dotted address does.
    """
    counted = nodes.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("layer") == "host").alias("n_hosts"), F.count("parent").alias("n_subservices"), F.count_if(F.contains("address", F.lit("."))).alias("n_addresses"))
    return counted.withColumn("distributed", (F.col("n_nodes") > most) | (F.col("n_hosts") > 1) | (F.col("n_subservices") > 0) | (F.col("n_addresses") > 0))
