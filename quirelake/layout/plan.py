"""The layout pass as a plan: document statistics by groups, joined back, then each page on its own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake import ship
from quirelake.operators import layout

RENDERED = "text string, structured boolean, n_tables int, headings array<struct<text:string,level:int>>, tables array<struct<headers:array<string>,rows:array<array<string>>>>, warning string"


def document_stats(words: DataFrame, doc: str, ocr: bool = False) -> DataFrame:
    """(doc, body_em, body_bold_ratio, levels): one row a document, from grouped sums."""
    levels = layout.heading_levels(words, doc, ocr).groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("em", "level"))).alias("levels"))
    return layout.body_stats(words, doc).join(levels, doc, "left")


def render_pages(words: DataFrame, doc: str, page: str, plain: DataFrame | None = None, ocr: bool = False) -> DataFrame:
    """One row a page with words: its text, whether it is structured, its tables and headings.

    words: (doc, page, x0, y0, x1, y1, text, size, bold). plain: (doc, page, plain), what unstructured pages keep; without it, their words
    joined. A page whose rendering fails keeps its plain text and gets a warning with the error's class. Words
    of a page come together as one array, so a long document is as many tasks as it has pages.
    """
    ship(words.sparkSession)
    box = F.struct("y0", "x0", "x1", "y1", "text", "size", "bold")
    pages = words.groupBy(doc, page).agg(F.sort_array(F.collect_list(box)).alias("words")).join(document_stats(words, doc, ocr), doc)
    if plain is not None:
        pages = pages.join(plain, [doc, page], "left")
    else:
        pages = pages.withColumn("plain", F.array_join(F.transform("words", lambda w: w["text"]), " "))
    pages = pages.select(doc, page, "words", "body_em", "body_bold_ratio", "levels", F.coalesce("plain", F.lit("")).alias("plain"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from quirelake.layout.page import DocumentStats, Rendered, Word, render_page

        for pdf in batches:
            made = []
            for r in pdf.itertuples(index=False):
                own = dict(zip(pdf.columns, r, strict=True))
                levels = tuple((x["em"], x["level"]) for x in own["levels"]) if own["levels"] is not None else ()
                stats = DocumentStats(own["body_em"], own["body_bold_ratio"], levels, frozenset(), ocr)
                boxes = [Word(w["x0"], w["y0"], w["x1"], w["y1"], w["text"] or "", w["size"], bool(w["bold"])) for w in own["words"]]
                warning = None
                try:
                    got = render_page(boxes, own["plain"], stats)
                except (ValueError, ArithmeticError, LookupError) as e:
                    got, warning = Rendered(own["plain"], False), f"layout: page kept as plain text ({type(e).__name__})"
                made.append((own[doc], own[page], got.text, got.structured, len(got.tables), got.headings, got.tables, warning))
            yield pd.DataFrame(made, columns=[doc, page, "text", "structured", "n_tables", "headings", "tables", "warning"])

    kinds = f"`{doc}` {pages.schema[doc].dataType.simpleString()}, `{page}` {pages.schema[page].dataType.simpleString()}"
    return pages.mapInPandas(run, f"{kinds}, {RENDERED}")
