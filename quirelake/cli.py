"""Command line: extract the files of a path or glob and print JSON, or write a table."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quirelake.sources.extract import extract, read_files, to_json


def main(argv: list[str] | None = None) -> int:
    """0 if all documents were read, 1 if some were refused, 2 for wrong use."""
    p = argparse.ArgumentParser(prog="quirelake")
    p.add_argument("path")
    p.add_argument("--mime")
    p.add_argument("--out", help="write Parquet there instead of printing")
    p.add_argument("--emit-markdown", action="store_true")
    p.add_argument("--emit-sentences", action="store_true")
    p.add_argument("--text-mode", choices=("plain", "layout"), default="plain")
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = SparkSession.builder.appName("quirelake").getOrCreate()
    try:
        files = read_files(spark, args.path)
    except AnalysisException as e:
        print(e.getMessage() or "no such path", file=sys.stderr)
        return 2
    if args.mime:
        files = files.withColumn("mime", F.lit(args.mime))
    results = extract(files, mime="mime" if args.mime else None, emit_markdown=args.emit_markdown, emit_sentences=args.emit_sentences, text_mode=args.text_mode)
    if args.out:
        results.write.mode("overwrite").parquet(args.out)
        return int(bool(spark.read.parquet(args.out).filter("error is not null").limit(1).count()))
    refused = False
    for row in to_json(results.withColumn("__error", F.col("error").isNotNull())).toLocalIterator():
        refused |= '"__error":true' in row.value
        print(row.value)
    return int(refused)


if __name__ == "__main__":
    sys.exit(main())
