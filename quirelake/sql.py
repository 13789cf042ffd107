"""Functions for SQL: register(spark), then SELECT canonicalize_text(t), or FROM docs, LATERAL extract_sentences(t)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quirelake import ship


class _Sentences:
    """index, text, char_start, char_end, line_start, line_end of each sentence."""

    def eval(self, text: str):
        import re

        if not text:
            return
        at, line, index = 0, 1, 0
        cuts = [m.end(1) for m in re.finditer(r"(?<=[.!?])(\s+)(?=[A-ZÜÖÄ\d\"'(])", text)]
        for start, end in zip([0, *cuts], [*cuts, len(text)], strict=True):
            piece = text[start:end]
            body = piece.strip()
            at = start + len(piece) - len(piece.lstrip())
            first = line + text.count("\n", start, at)
            if body:
                yield index, body, at, at + len(body), first, first + body.count("\n")
                index += 1
            line += piece.count("\n")


class _Sections:
    """heading, level, text, line_start, line_end of each ATX heading's section."""

    def eval(self, markdown: str):
        import re

        from quirelake.sources.record import sections_of

        lines = (markdown or "").split("\n")
        heads = [(i, len(m[1]), m[2]) for i, x in enumerate(lines) if (m := re.match(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$", x))]
        for s in sections_of(heads, lines):
            yield s["heading"], s["level"], s["text"], s["line_start"], s["line_end"]


class _Tables:
    """hint, headers and rows of each table of an HTML document."""

    def eval(self, html: str):
        from quirelake.sources.html_dom import parse, tables

        for t in tables(parse(html or "")[0], []):
            yield t["client_table_hint"], t["headers"], t["rows"]


#: Scalar functions: name, what it computes of a string, its type.
SCALARS = {
    "canonicalize_text": ("quirelake.sources.record", "canonical", "string"),
    "est_tokens": ("quirelake.layout.tokens", "est_tokens", "long"),
    "clean_cell": ("quirelake.layout.tokens", "clean_cell", "string"),
    "lint_row": ("quirelake.layout.tokens", "lint", "string"),
    "is_amount": ("quirelake.layout.tokens", "is_amount", "boolean"),
    "html_body_text": ("quirelake.sources.mail", "html_body_text", "string"),
    "pdf_date_iso": ("quirelake.sources.pdf", "iso_date", "string"),
    "mail_date_iso": ("quirelake.sources.mail", "iso_date", "string"),
    "scrub_markdown_links": ("quirelake.sources.html_dom", "scrub_links", "string"),
}


def _scalar(module: str, name: str, kind: str):
    def run(values: pd.Series) -> pd.Series:
        import importlib

        f = getattr(importlib.import_module(module), name)
        return values.map(lambda v: None if v is None else f(v))

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    ship(spark)
    for name, (module, function, kind) in SCALARS.items():
        spark.udf.register(name, _scalar(module, function, kind))
    tables = {
        "extract_sentences": (_Sentences, "index int, text string, char_start int, char_end int, line_start int, line_end int"),
        "extract_sections": (_Sections, "heading string, level int, text string, line_start int, line_end int"),
        "html_tables": (_Tables, "hint string, headers array<string>, rows array<array<string>>"),
    }
    for name, (handler, kind) in tables.items():
        spark.udtf.register(name, F.udtf(handler, returnType=kind))
    return [*SCALARS, *tables]
