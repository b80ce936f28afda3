"""The corpus pipeline: stages over ``documents``, each one of the operators.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``docs``. The driver writes a
stage's rows as Parquet and reads them again as the next one's ``docs``;
:func:`run` does the same in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import bpe, decontam, langid, neardup, pii
from codeloom.plans.shared import materialize

STAGES = [
    ("language identification", langid.kept_language),
    ("near duplicates", neardup.kept_one_each),
    ("benchmark decontamination", decontam.kept_clean),
    ("personal data", pii.redacted),
    ("tokenization", bpe.tokenized),
]
#: No SQL expresses the first stage's classifier, nor the last stage's tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents`` in turn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i + 1}")
    return docs
