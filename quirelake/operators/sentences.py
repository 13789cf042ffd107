"""Sentences with exact coordinates, their sections, citations and chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import BLANK
from quirelake.schema import Limits

if TYPE_CHECKING:
    import pyarrow as pa

#: Pieces that are folded at a time; blocks of them keep the fold linear in the text.
_BLOCK = 128
# What a sentence ends and the next one starts with; languages with rules of their own.
ENDS, STARTS = ".!?", "A-ZÜÖÄ\\d\"'("
LANGUAGES = "am ar bg da de el en es fa fr hi hy it ja kk mr my nl pl ru sk ur zh".split()


def resolve_language(language: Column) -> Column:
    """Lower-cased base code if there are rules for it, else en."""
    base = F.regexp_extract(F.lower(F.coalesce(language, F.lit(""))), r"^([^\-_]*)", 1)
    return F.when(base.isin(*LANGUAGES), base).otherwise("en")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(text: Column) -> Column:
    """The text cut behind each boundary's blanks; together the pieces are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).+?(?:(?<=[{ENDS}]){BLANK}+(?=[{STARTS}])|\z)"), F.lit(0))


def sentences(text: Column, max_sentences: int | None = Limits.max_sentences) -> Column:
    """array<struct<index, text, char_start, char_end, line_start, line_end>>: 0-based half-open code points, 1-based lines.

    text[char_start:char_end] is the sentence. Empty text has none, null text null. Sentences beyond the cap, if there is one, are left out. All
    happens within the row, without a shuffle: running sums over blocks of pieces, and over the pieces of each block.
    """
    place, found_type = "struct<at:int,line:int>", "array<struct<text:string,char_start:int,line_start:int>>"

    def step(acc: Column, piece: Column) -> Column:
        body = F.regexp_replace(piece, rf"^{BLANK}+|{BLANK}+\z", "")
        lead = F.length(piece) - F.length(F.regexp_replace(piece, rf"^{BLANK}+", ""))
        line = acc["line"] + F.regexp_count(F.substring(piece, F.lit(1), lead), F.lit("\n"))
        found = F.when(body != "", F.array(F.struct(body.alias("text"), (acc["at"] + lead).alias("char_start"), line.alias("line_start")))).otherwise(F.array().cast(found_type))
        return F.struct(
            (acc["at"] + F.length(piece)).alias("at"), (acc["line"] + F.regexp_count(piece, F.lit("\n"))).alias("line"), F.concat(acc["out"], found).alias("out")
        )

    def over(acc: Column, block: Column) -> Column:
        whole = F.array_join(block, "")
        at, line = acc["at"] + F.length(whole), acc["line"] + F.regexp_count(whole, F.lit("\n"))
        return F.struct(at.alias("at"), line.alias("line"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), acc["line"].alias("line")))).alias("out"))

    def fold(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.struct(start["at"].alias("at"), start["line"].alias("line"), F.array().cast(found_type).alias("out")), step)["out"]

    def blocks(pieces: Column) -> Column:
        numbers = F.when(F.size(pieces) > 0, F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.when(pieces.isNotNull(), F.transform(numbers, lambda b: F.slice(pieces, b * _BLOCK + 1, F.lit(_BLOCK))))

    first = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.array().cast(f"array<{place}>").alias("out"))
    cut = _let(_pieces(text) if max_sentences is None else F.slice(_pieces(text), 1, max_sentences), blocks)
    found = _let(cut, lambda x: F.flatten(F.zip_with(x, F.aggregate(x, first, over)["out"], fold)))
    return F.transform(
        found,
        lambda s, i: F.struct(
            i.alias("index"),
            s["text"].alias("text"),
            s["char_start"].alias("char_start"),
            (s["char_start"] + F.length(s["text"])).alias("char_end"),
            s["line_start"].alias("line_start"),
            (s["line_start"] + F.regexp_count(s["text"], F.lit("\n"))).alias("line_end"),
        ),
    )


def cap_warning(text: Column, max_sentences: int = Limits.max_sentences) -> Column:
    """What the sentence cap left out, or null."""
    beyond = F.size(_pieces(text)) - max_sentences
    return F.when(beyond > 0, F.concat(F.lit("sentences: "), beyond.cast("string"), F.lit(f" beyond max_sentences ({max_sentences}) omitted")))


def exploded(df: DataFrame, keys: list[str], text: str = "text", max_sentences: int | None = Limits.max_sentences) -> DataFrame:
    """One row a sentence, with the key columns."""
    return df.select(*keys, F.explode(sentences(F.col(text), max_sentences)).alias("s")).select(*keys, "s.*")


def page_sentences(pages: DataFrame, doc: str, page: str, text: str, max_sentences: int = Limits.max_sentences) -> DataFrame:
    """Sentences of paged documents, placed in the pages joined by a blank line; the cap holds for the document.

    Pages are put in order in one array per document, so each page's offset is a running sum within the row. Empty pages keep their separator.
    """
    grouped = pages.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(page).alias("page"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("p"))
    kind = "array<struct<page_index:int,page:bigint,text:string,at:int,line:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.array().cast(kind).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        own = F.struct(F.size(acc["out"]).alias("page_index"), p["page"].cast("long").alias("page"), p["text"].alias("text"), acc["at"].alias("at"), acc["line"].alias("line"))
        return F.struct(
            (acc["at"] + F.length(p["text"]) + 2).alias("at"), (acc["line"] + F.regexp_count(p["text"], F.lit("\n")) + 2).alias("line"), F.concat(acc["out"], F.array(own)).alias("out")
        )

    placed = grouped.select(doc, F.explode(F.aggregate("p", start, step)["out"]).alias("p"))
    rows = placed.select(doc, "p", F.explode(sentences(F.col("p.text"), max_sentences)).alias("s"))
    rows = rows.select(
        doc,
        F.col("p.page_index").alias("page_index"),
        (F.col("p.page_index") + 1).alias("page_number"),
        F.col("s.text").alias("text"),
        *[(F.col(f"s.{c}") + F.col("p.at")).alias(c) for c in ("char_start", "char_end")],
        *[(F.col(f"s.{c}") + F.col("p.line") - 1).alias(c) for c in ("line_start", "line_end")],
    )
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy(doc).orderBy("char_start")) - 1
    return rows.withColumn("index", index).filter(F.col("index") < max_sentences)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Innermost sections of events sorted by document, line and kind: a section opens (its length and last line are set), a sentence asks.

    Open sections are a heap, the smallest and first on top; lines only rise, so what has ended there has ended for good. Columns behind the
    sixth are the sections' and are given to the sentences.
    """
    import heapq

    import pyarrow as pa

    doc, heap, opened = None, [], 0
    for batch in batches:
        asked, found = [], []
        docs, lines, indexes, lengths, lasts = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
        more = [c.to_pylist() for c in batch.columns[6:]]
        for k, own in enumerate(docs):
            if own != doc:
                doc, heap = own, []
            if lasts[k] is not None:
                opened += 1  # before the carried values, which need not have an order
                heapq.heappush(heap, (lengths[k], indexes[k], lasts[k], opened, [c[k] for c in more]))
                continue
            while heap and heap[0][2] < lines[k]:
                heapq.heappop(heap)
            if heap:
                asked.append(k)
                found.append(heap[0])
        rows, fields = pa.array(asked, pa.int64()), list(batch.schema)[6:]
        carried = [pa.array([x[4][j] for x in found], f.type) for j, f in enumerate(fields)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(3).take(rows), pa.array([x[1] for x in found], pa.int64()), *carried], ["w_doc", "w_index", "section_index", *(f.name for f in fields)]
        )


def section_links(found: DataFrame, sections: DataFrame, doc: str, carried: Sequence[str] = ()) -> DataFrame:
    """(doc, index, section_index) of the sentences that a section holds, with the carried columns of that section: the innermost one whose lines hold the sentence's first line, the first of equals.

    Both are swept once in the order of their document's lines, so that no sentence meets each section; the sentences' texts stay out of it.
    """
    key, none = F.col(doc).alias("doc"), F.lit(None).cast("long")
    long = lambda c: F.col(c).cast("long")
    names = [f"c{k}" for k in range(len(carried))]
    kinds = [sections.schema[c].dataType for c in carried]
    opens = sections.filter(F.col("line_start") <= F.col("line_end")).select(key, long("line_start").alias("line"), F.lit(0).alias("kind"), long("index").alias("i"), (long("line_end") - long("line_start")).alias("length"), long("line_end").alias("last"), *[F.col(c).alias(n) for c, n in zip(carried, names, strict=True)])
    asks = found.filter(F.col("line_start").isNotNull()).select(key, long("line_start").alias("line"), F.lit(1).alias("kind"), long("index").alias("i"), none.alias("length"), none.alias("last"), *[F.lit(None).cast(t).alias(n) for t, n in zip(kinds, names, strict=True)])
    events = opens.unionByName(asks).filter("doc is not null").repartition("doc").sortWithinPartitions("doc", "line", "kind")
    more = "".join(f", {n} {t.simpleString()}" for n, t in zip(names, kinds, strict=True))
    inner = events.mapInArrow(_sweep, f"w_doc {events.schema['doc'].dataType.simpleString()}, w_index long, section_index long{more}")
    return inner.select(F.col("w_doc").alias(doc), F.col("w_index").alias("index"), F.col("section_index").cast(sections.schema["index"].dataType), *[F.col(n).alias(c) for c, n in zip(carried, names, strict=True)])


def with_sections(found: DataFrame, sections: DataFrame, doc: str, carried: Sequence[str] = ()) -> DataFrame:
    """Sentences with section_index and the carried columns of their section (section_links); null where no section holds the sentence's first line."""
    return found.join(section_links(found, sections, doc, carried), [doc, "index"], "left")


def citations(found: DataFrame, sections: DataFrame, doc: str) -> DataFrame:
    """Sentences with their section's heading; sections has doc, index, heading, line_start and line_end.

    Where they are from (a digest, a path) found has from its documents, as key columns of exploded(). So texts are shuffled once, to meet their heading.
    """
    return with_sections(found, sections, doc, ["heading"])


def chunks(found: DataFrame, doc: str, size: int, headed: DataFrame | None = None) -> DataFrame:
    """Runs of `size` sentences: text joined by blanks, the span in characters and lines, the distinct headings sorted.

    headed: (doc, index, heading) of sentences, as of section_links. Headings are gathered by chunk before they meet the chunks, so texts are shuffled once, to their chunk.
    """
    keys = [F.col(doc), F.floor(F.col("index") / size).alias("chunk")]
    piece = F.sort_array(F.collect_list(F.struct("index", "text")))
    grouped = found.groupBy(*keys).agg(piece.alias("p"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))
    if headed is not None:
        kind = headed.schema["heading"].dataType.simpleString()
        heads = headed.groupBy(*keys).agg(F.array_sort(F.collect_set("heading")).alias("headings"))
        grouped = grouped.join(heads, [doc, "chunk"], "left").withColumn("headings", F.coalesce("headings", F.array().cast(f"array<{kind}>")))
    return grouped.withColumn("text", F.array_join(F.transform("p", lambda x: x["text"]), " ")).drop("p")


def violations(found: DataFrame, texts: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """Sentences that break a law: span out of range, text not at its span, lines out of order, overlap with the one before."""
    from pyspark.sql import Window

    whole = texts.select(F.col(doc).alias("v_doc"), F.col(text).alias("v_text"))
    order = Window.partitionBy(doc).orderBy("index")
    checked = found.withColumn("before", F.lag("char_end").over(order)).join(whole, F.col(doc) == F.col("v_doc"))
    broken = F.concat_ws(
        ",",
        F.when((F.col("char_start") < 0) | (F.col("char_end") > F.length("v_text")) | (F.col("char_start") >= F.col("char_end")), "range"),
        F.when(F.substring(F.col("v_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) != F.col("text"), "text"),
        F.when((F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start")), "lines"),
        F.when(F.col("before") > F.col("char_start"), "overlap"),
    )
    return checked.withColumn("broken", broken).filter("broken <> ''").drop("before", "v_doc", "v_text")
