"""What a file is, and where it came from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
# Suffixes and their types.
SUFFIXES = {
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".pdf": "application/pdf",
    ".docx": DOCX,
    ".html": "text/html",
    ".htm": "text/html",
    ".rtf": "application/rtf",
    ".eml": "message/rfc822",
    ".msg": "application/vnd.ms-outlook",
}


def canonical_mime(mime: Column) -> Column:
    return F.when(mime == "text/rtf", "application/rtf").otherwise(mime)


def _starts(data: Column, *heads: bytes) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | (F.substring(data, 1, len(h)) == F.unhex(F.lit(h.hex())))
    return out


def by_suffix(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"[^/\\.](\.[^./\\]+)$", 1))
    table = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))
    return F.try_element_at(table, suffix)


def mime_type(data: Column, name: Column | None = None, given: Column | None = None) -> Column:
    """The caller's type, else a known suffix's, else what the first bytes show, else text if these are UTF-8."""
    text = F.is_valid_utf8(F.substring(data, 1, 1024).cast("string"))
    shown = (
        F.when(_starts(data, b"%PDF-"), "application/pdf")
        .when(_starts(data, b"{\\rtf"), "application/rtf")
        .when(_starts(data, b"<!DOCTYPE html", b"<html", b"<HTML"), "text/html")
        .when(text, "text/plain")
        .otherwise("application/octet-stream")
    )
    choices = [given] if given is not None else []
    choices += [by_suffix(name)] if name is not None else []
    return canonical_mime(F.coalesce(*choices, shown))


def source_stamp(data: Column, path: Column, mime: Column) -> Column:
    """struct<mime_type, sha256, size_bytes, filename, path> of a file's bytes."""
    return F.struct(
        mime.alias("mime_type"), F.sha2(data, 256).alias("sha256"), F.length(data).cast("long").alias("size_bytes"), F.regexp_extract(path, r"([^/\\]*)$", 1).alias("filename"), path.alias("path")
    )


def decoded(data: Column) -> Column:
    """struct<text, charset>: a byte-order mark decides, else UTF-8 if the bytes are, else ISO 8859-1, which reads any bytes."""
    marked = lambda mark: _starts(data, mark)
    tail = lambda n: F.substring(data, F.lit(n + 1), F.length(data))
    return (
        F.when(marked(b"\xef\xbb\xbf"), F.struct(F.make_valid_utf8(tail(3).cast("string")).alias("text"), F.lit("utf-8-sig").alias("charset")))
        .when(marked(b"\xff\xfe"), F.struct(F.decode(tail(2), "UTF-16LE"), F.lit("utf-16-le")))
        .when(marked(b"\xfe\xff"), F.struct(F.decode(tail(2), "UTF-16BE"), F.lit("utf-16-be")))
        .when(F.is_valid_utf8(data.cast("string")), F.struct(data.cast("string"), F.lit("utf-8")))
        .otherwise(F.struct(F.decode(data, "ISO-8859-1"), F.lit("iso-8859-1")))
    )
