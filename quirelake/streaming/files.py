"""Extraction of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirelake.schema import Limits
from quirelake.sources.extract import extract

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def extract_stream(files: DataFrame, out: str, checkpoint: str, limits: Limits = Limits(), available_now: bool = False, **options) -> StreamingQuery:
    """Append results to the Parquet table `out`; contents seen before, in the batch or in the table, are not extracted again.

    A batch that is run again after a failure finds its results by content and adds nothing twice.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        fresh = df.filter(F.col("length") <= limits.max_input_bytes).withColumn("sha256", F.sha2("content", 256))
        try:
            known = spark.read.parquet(out).select(F.col("source.sha256").alias("sha256")).distinct()
            fresh = fresh.join(known, "sha256", "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        first = fresh.groupBy("sha256").agg(F.min("path").alias("path"))
        once = fresh.join(first, ["sha256", "path"], "left_semi")
        extract(once.select("path", "content"), limits=limits, **options).write.mode("append").parquet(out)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
