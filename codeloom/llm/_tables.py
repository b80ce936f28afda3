"""Reading the input tables; only the columns an operator names leave the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: bounds a Python worker's memory where texts are long.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of an input table; extra columns never meet the operator's own."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, since one row can hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def remainder5(doc_id="doc_id"):
    """crc32 of the id as text, mod 5 (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def spare(df: DataFrame, name: str) -> str:
    """A name for a working column that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
