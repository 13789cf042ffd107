"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirelake.llm import stages
from quirelake.llm.common import table
from quirelake.llm.warc import delete_folder, shared_folder

STAGES = [
    ("quality rules", stages.quality_stage),
    ("toxicity", stages.toxicity_stage),
    ("near-duplicates", stages.dedup_stage),
    ("benchmark decontamination", stages.decontamination_stage),
    ("source mixing", stages.mixing_stage),
]

#: Stages that learn or hash cannot be said in SQL; tests hold each against a plain form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages make of documents. Their tables lie in a fresh folder below the checkpoint folder, each until the next is written, the last for the caller to delete; none after a failure."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark).replace("warc-", "pipeline-")
    try:
        for k, (_, stage) in enumerate(STAGES):
            path = f"{folder}/{k}.parquet"
            stage(spark, docs, sf_dir).write.parquet(path)
            if k:
                delete_folder(spark, f"{folder}/{k - 1}.parquet")
            docs = spark.read.parquet(path)
    except BaseException:
        delete_folder(spark, folder)
        raise
    return docs
