"""The corpus pipeline: from documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet in the shared folder and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemerge.llm import langid, mixing, neardup, packing, secret_scan
from tidemerge.llm.common import table, written

STAGES = [
    ("language_id", langid.stage),
    ("near_duplicates", neardup.stage),
    ("secret_scan", secret_scan.stage),
    ("source_mixing", mixing.stage),
    ("best_fit_packing", packing.stage),
]

#: SQL can express neither the learned language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
