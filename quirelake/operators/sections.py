"""Sections of Markdown and HTML, and front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HEADING = r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$"


def section_spans(df: DataFrame, doc: str, text: str = "text", any_level: bool = False) -> DataFrame:
    """(doc, index, heading, level, line_start, line_end) of ATX headings.

    A section ends before the next heading of its level or a higher one (with any_level, before any); lines are 1-based, the heading's first. The next
    such heading of a level is the nearest of at most six running minima from the last heading on, so that no headings are compared in pairs
    and none carries the document's lines.
    """
    lines = df.select(doc, F.split(text, "\n").alias("l"))
    heads = lines.select(doc, F.size("l").alias("n"), F.posexplode("l").alias("at", "line")).filter(F.col("line").rlike(_HEADING))
    heads = heads.select(doc, "n", "at", F.length(F.regexp_extract("line", _HEADING, 1)).alias("level"), F.regexp_extract("line", _HEADING, 2).alias("heading"))
    after = Window.partitionBy(doc).orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.min(F.when(F.col("level") <= k, F.col("at"))).over(after) for k in range(1, 7)]
    end = F.min("at").over(after) if any_level else F.element_at(F.array(*ends), F.col("level"))
    placed = heads.withColumn("end", F.coalesce(end, F.col("n"))).withColumn("index", F.row_number().over(Window.partitionBy(doc).orderBy("at")) - 1)
    return placed.select(doc, "index", "heading", "level", (F.col("at") + 1).alias("line_start"), F.col("end").alias("line_end"))


def markdown_sections(df: DataFrame, doc: str, text: str = "text", any_level: bool = False) -> DataFrame:
    """section_spans with the sections' text, which leaves the heading out and has the sections below it.

    The spans meet the document as one array, and each text is cut from its lines within the row.
    """
    names = ("index", "heading", "level", "line_start", "line_end")
    spans = section_spans(df, doc, text, any_level).groupBy(F.col(doc).alias("s_doc")).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("s"))
    met = df.select(doc, F.col(text).alias("t")).join(spans, F.col(doc).eqNullSafe(F.col("s_doc")))
    body = lambda l, x: F.array_join(F.slice(l, x["line_start"] + 1, x["line_end"] - x["line_start"]), "\n")
    cut = lambda l, x: F.struct(*[x[n].alias(n) for n in names], F.regexp_replace(body(l, x), r"^\s+|\s+\z", "").alias("text"))
    # An array of one element: its lines are split once, not once a section.
    rows = F.flatten(F.transform(F.array(F.split("t", "\n")), lambda l: F.transform("s", lambda x: cut(l, x))))
    return met.select(doc, F.explode(rows).alias("x")).select(doc, "x.index", "x.heading", "x.level", "x.text", "x.line_start", "x.line_end")


def frontmatter(text: Column) -> Column:
    """struct<fields map<string,string>, body>: the `key: value` lines of a leading --- block, and what follows it. Names are lower-cased; of one name the last line counts."""
    block = F.regexp_extract(text, r"(?s)\A---[ \t]*\n(.*?\n)---[ \t]*(?:\n|\z)", 1)
    has = text.rlike(r"(?s)\A---[ \t]*\n(.*?\n)---[ \t]*(?:\n|\z)")
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z0-9_\-]+[ \t]*:"))
    trimmed = lambda c: F.regexp_replace(c, r"""^[ \t]*["']?|["']?[ \t]*$""", "")
    pairs = F.transform(lines, lambda x: F.struct(F.lower(trimmed(F.regexp_extract(x, r"^([^:]*):", 1))).alias("key"), trimmed(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["key"] == n), -1)["value"])
    body = F.when(has, F.regexp_replace(text, r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)", "")).otherwise(text)
    return F.struct(F.map_from_arrays(names, last).alias("fields"), body.alias("body"))


def promoted(fields: Column) -> Column:
    """struct<title, author, language, created, modified, extra> of front matter; date stands in for created, the rest are extra."""
    get = lambda k: F.try_element_at(fields, F.lit(k))
    own = ("title", "author", "language", "date", "created", "modified")
    rest = F.map_filter(fields, lambda k, v: ~F.lower(k).isin(*own))
    extra = F.transform_keys(rest, lambda k, v: F.concat(F.lit("md:frontmatter."), F.lower(k)))
    return F.struct(
        get("title").alias("title"), get("author").alias("author"), get("language").alias("language"), F.coalesce(get("created"), get("date")).alias("created"), get("modified").alias("modified"), extra.alias("extra")
    )
