"""Running an OCR engine over pages: engines are callables, failures and budgets are statuses."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.operators import ocr
from quirelake.schema import Limits

#: engine(image bytes, options) -> TSV of the page; it may raise.
Engine = Callable[[bytes, dict], str]


def recognize(pages: DataFrame, keys: list[str], engine: Engine, options: dict | None = None, limits: Limits = Limits(), clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """pages (keys, image, status) with tsv: pages whose status is done are read; an engine's error makes it failed.

    The first key is the document. Its pages are read in order by one task, and once they have spent the time budget, the rest of
    that document's pages are skipped; the next document's clock starts anew. Images that are not to be read are not shuffled. One Python worker is one engine.
    """
    options = options or {}
    budget = limits.ocr_time_budget_seconds
    image = F.when(F.col("status") == "done", F.col("image")).alias("image")
    narrow = pages.select(*keys, image, "status").repartition(F.col(keys[0])).sortWithinPartitions(*keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        began, last = 0.0, object()
        for pdf in batches:
            status, read = [], []
            for own, image, was in zip(pdf[keys[0]], pdf["image"], pdf["status"], strict=True):
                own = None if pd.isna(own) else own
                if own != last:
                    began, last = clock(), own
                tsv = None
                if was == "done" and clock() - began > budget:
                    was = "skipped"
                elif was == "done":
                    try:
                        tsv = engine(bytes(image) if image is not None else b"", options)
                    except Exception:  # whatever an engine raises, its page has failed
                        was = "failed"
                status.append(was)
                read.append(tsv)
            yield pdf[keys].assign(status=status, tsv=read)

    kinds = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys)
    return narrow.mapInPandas(run, f"{kinds}, status string, tsv string")


def run_document_ocr(pages: DataFrame, doc: str, page: str, engine: Engine, cache: DataFrame | None = None, limits: Limits = Limits(), **options) -> DataFrame:
    """pages (doc, page, layer, cover, image, megapixels) with decision, status, tsv, key and page text.

    Pages that need no engine keep their layer. Of the others the cache (key, tsv) answers what it has; the rest is scheduled by the page cap and read.
    """
    from quirelake.functions.text import decide_page

    told = {"language": "deu+eng", "psm": 3, "engine": "engine", "preproc": "none"} | options
    decided = pages.withColumn("decision", decide_page(F.col("layer"), F.col("cover"))).withColumn("needs_ocr", F.col("decision.needs_ocr"))
    key = ocr.cache_key(F.sha2(F.coalesce("image", F.lit("").cast("binary")), 256), F.lit(0), F.lit(300), told["language"], told["psm"], told["engine"], told["preproc"])
    keyed = decided.withColumn("key", key)
    known = (cache if cache is not None else keyed.select("key", F.lit("").alias("tsv")).limit(0)).select("key", F.col("tsv").alias("cached")).dropDuplicates(["key"])
    keyed = keyed.join(known, "key", "left")
    asked = ocr.schedule(keyed.withColumn("failed", F.lit(False)).withColumn("needs_ocr", F.col("needs_ocr") & F.col("cached").isNull()), doc, page, limits)
    read = recognize(asked, [doc, page], engine, told, limits)
    out = keyed.join(read, [doc, page]).withColumn("tsv", F.coalesce("cached", "tsv"))
    out = out.withColumn("status", F.when(F.col("cached").isNotNull() & F.col("needs_ocr"), "done").otherwise(F.col("status")))
    texts = ocr.words_to_text(ocr.parse_tsv(out.filter("tsv is not null"), [doc, page]), [doc, page])
    joined = out.join(texts.select(doc, page, F.col("text").alias("read"), F.col("mean_conf").alias("conf")), [doc, page], "left")
    return joined.withColumn("text", ocr.page_text(F.col("layer"), F.col("decision"), F.col("read"))).drop("cached", "read")
