"""Extraction: files to result rows, one Python stage a row and native columns around it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quirelake import ship
from quirelake.functions import text as T
from quirelake.operators import detect, sections, sentences
from quirelake.schema import SPEC_VERSION, Limits

if TYPE_CHECKING:
    import pyarrow as pa

_TABLE = "struct<client_table_hint:string,title:string,headers:array<string>,rows:array<array<string>>,page:int,bbox:array<double>>"
_SECTION = "struct<heading:string,level:int,text:string,line_start:int,line_end:int>"
_PAGE = "struct<index:int,text:string,line_start:int,line_end:int>"
PARSED = (
    f"text string, title string, author string, language string, created string, modified string, page_count int, extra map<string,string>, pages array<{_PAGE}>, sections array<{_SECTION}>, "
    f"tables array<{_TABLE}>, markdown string, warnings array<string>, error struct<kind:string,what:string,`limit`:double,observed:double>"
)

#: Types that a caller has added: reader(bytes, Limits) -> Parsed.
_ADDED: dict[str, Callable] = {}


def register_reader(mime: str, reader: Callable) -> None:
    """Read documents of a type with one's own function from bytes and limits to a Parsed record."""
    _ADDED[mime] = reader


def _decode(data: bytes) -> tuple[str, str]:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace"), name
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(data[: 1 << 16]).best()
        if best is not None:
            return data.decode(best.encoding, "replace"), best.encoding
    except ImportError:
        pass
    return data.decode("utf-8", "replace"), "utf-8"


def parse_one(data: bytes, mime: str, limits: Limits, emit_markdown: bool, text_mode: str, added: dict[str, Callable], bare_references: bool = True) -> dict:
    """A row of PARSED; refusals and failures become its error, never an exception."""
    from dataclasses import asdict

    from quirelake.sources.record import Parsed, Refusal, canonical

    out, error = Parsed(), None
    try:
        if len(data) > limits.max_input_bytes:
            raise Refusal("exhausted", "max_input_bytes", limits.max_input_bytes, len(data))
        if mime in added:
            out = added[mime](data, limits)
        elif mime in ("text/plain", "text/markdown"):
            if len(data) > limits.max_text_bytes:
                raise Refusal("exhausted", "max_text_bytes", limits.max_text_bytes, len(data))
            text, charset = _decode(data)
            out.text = canonical(text)
            out.extra = {"txt:charset": charset} if mime == "text/plain" else {}
            out.markdown = out.text if emit_markdown else None
        elif mime == "text/html":
            from quirelake.sources.html_dom import read_html

            out = read_html(_decode(data)[0], emit_markdown, limits.max_metadata_value_length, limits.max_recursion_depth, limits.max_markdown_expansion_ratio, bare_references)
        elif mime == "message/rfc822":
            from quirelake.sources.mail import read_mail

            out = read_mail(data, limits.max_metadata_value_length)
        elif mime == detect.DOCX:
            from quirelake.sources.office import read_docx

            out = read_docx(data, text_mode == "layout", limits.max_metadata_value_length, limits.max_decompression_ratio)
        elif mime == "application/rtf":
            from quirelake.sources.office import read_rtf

            out = read_rtf(data)
        elif mime == "application/pdf":
            from quirelake.sources.pdf import read_pdf

            out = read_pdf(data, limits.max_metadata_value_length, limits.max_pages)
        elif mime == "application/vnd.ms-outlook":
            from quirelake.sources.msg import read_msg

            out = read_msg(data, limits.max_metadata_value_length)
        else:
            raise Refusal("unsupported", mime)
        if len(out.text.encode("utf-8", "replace")) > limits.max_text_bytes:
            raise Refusal("exhausted", "max_text_bytes", limits.max_text_bytes, len(out.text))
    except Refusal as e:
        out, error = Parsed(), {"kind": e.kind, "what": e.what, "limit": e.limit, "observed": e.observed}
    except Exception as e:  # a reader's failure is the document's, not the job's
        out, error = Parsed(), {"kind": "corrupt", "what": type(e).__name__, "limit": None, "observed": None}
    return asdict(out) | {"error": error}


def parse(df: DataFrame, keys: list[str], content: str = "content", mime: str = "mime", limits: Limits = Limits(), emit_markdown: bool = True, text_mode: str = "plain", bare_references: bool = True) -> DataFrame:
    """The key columns and PARSED of each row's bytes."""
    if text_mode not in ("plain", "layout"):
        raise ValueError(f"text_mode is plain or layout, not {text_mode!r}")
    ship(df.sparkSession)
    types = to_arrow_schema(StructType.fromDDL(PARSED))
    narrow = df.select(*keys, F.col(content).alias("__content"), F.col(mime).alias("__mime"), (F.col("length") if "length" in df.columns else F.lit(None)).cast("double").alias("__length"))
    kinds = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys)
    added = dict(_ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for c, m, n in zip(*(batch.column(k) for k in range(len(keys), len(keys) + 3)), strict=True):
                c, n = c.as_py(), n.as_py()
                r = parse_one(c if c is not None else b"", m.as_py() or "", limits, emit_markdown, text_mode, added, bare_references)
                if c is None:
                    r["error"] = {"kind": "exhausted", "what": "max_input_bytes", "limit": float(limits.max_input_bytes), "observed": n}
                r["extra"] = list(r["extra"].items())
                rows.append(r)
            parsed = [pa.array([r[t.name] for r in rows], t.type) for t in types]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), *parsed], [*keys, *types.names])

    return narrow.mapInArrow(run, f"{kinds}, {PARSED}")


def extract(files: DataFrame, path: str = "path", content: str = "content", mime: str | None = None, limits: Limits = Limits(), emit_markdown: bool = True, emit_sentences: bool = False, text_mode: str = "plain", bare_references: bool = True) -> DataFrame:
    """One result row a file (path, content[, mime]), in the shape of schema.EXTRACTION.

    Hostile paths, oversize input and unreadable documents give a row with an error. Parsing is one Python stage; type, fingerprint, word count,
    sentences and their sections are columns. Bytes are not shuffled. bare_references: whether HTML's references without a semicolon count.
    """
    given = F.col(mime) if mime else None
    typed = files.withColumn("__kind", detect.mime_type(F.col(content), F.col(path), given))
    stamped = typed.withColumn("source", detect.source_stamp(F.col(content), F.col(path), F.col("__kind")))
    parsed = parse(stamped.withColumn("__path_error", T.path_error(F.col(path), limits)), ["source", "__path_error"], content, "__kind", limits, emit_markdown, text_mode, bare_references)
    md = F.col("source.mime_type") == "text/markdown"
    front = F.when(md, sections.frontmatter(F.col("text")))
    told = sections.promoted(F.coalesce(front["fields"], F.create_map().cast("map<string,string>")))
    parsed = parsed.withColumn("__front", told).withColumn("text", F.coalesce(front["body"], F.col("text")))
    parsed = parsed.withColumn("markdown", F.when(md & F.col("markdown").isNotNull(), F.col("text")).otherwise(F.col("markdown")))
    meta = F.struct(
        *[F.coalesce(F.col(n), F.col(f"__front.{n}")).alias(n) for n in ("title", "author", "language", "created", "modified")],
        "page_count",
        T.word_count(F.col("text")).alias("word_count"),
        F.map_concat(F.coalesce("extra", F.create_map().cast("map<string,string>")), F.coalesce("__front.extra", F.create_map().cast("map<string,string>"))).alias("extra"),
    )
    none_if_empty = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    found = sentences.sentences(F.col("text"), limits.max_sentences) if emit_sentences else None
    if found is not None:
        holds = lambda s: F.filter(
            F.transform(F.coalesce("sections", F.array().cast(f"array<{_SECTION}>")), lambda x, i: F.struct((x["line_end"] - x["line_start"]).alias("span"), i.alias("i"), x["line_start"].alias("a"), x["line_end"].alias("b"))),
            lambda x: (x["a"] <= s["line_start"]) & (x["b"] >= s["line_start"]),
        )
        of_page = lambda s: F.filter(F.coalesce("pages", F.array().cast(f"array<{_PAGE}>")), lambda p: (p["line_start"] <= s["line_start"]) & (p["line_end"] >= s["line_start"]))
        found = F.transform(
            found,
            lambda s: F.struct(
                *[s[c].alias(c) for c in ("index", "text", "char_start", "char_end", "line_start", "line_end")],
                F.get(of_page(s), F.lit(0))["index"].alias("page_index"),
                (F.get(of_page(s), F.lit(0))["index"] + 1).alias("page_number"),
                F.array_min(holds(s))["i"].alias("section_index"),
            ),
        )
    content_ = F.struct(
        "text", none_if_empty("pages"), none_if_empty("sections"), "markdown", (found if found is not None else F.lit(None).cast("array<struct<index:int,text:string,char_start:int,char_end:int,line_start:int,line_end:int,page_index:int,page_number:int,section_index:int>>")).alias("sentences"), none_if_empty("tables"),
    )
    refused = F.when(F.col("__path_error").isNotNull(), F.struct(F.lit("value").alias("kind"), F.concat(F.lit("path: "), F.col("__path_error")).alias("what"), F.lit(None).cast("double").alias("limit"), F.lit(None).cast("double").alias("observed")))
    return parsed.select(
        F.lit(SPEC_VERSION).alias("spec_version"),
        "source",
        meta.alias("metadata"),
        content_.alias("content"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
        F.struct(F.concat(F.lit("quirelake."), F.regexp_extract(F.col("source.mime_type"), r"([^/.]*)$", 1)).alias("name"), F.lit("0.1.0").alias("version")).alias("extractor"),
        F.coalesce(refused, F.col("error")).alias("error"),
    )


def read_files(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """(path, content, length) of the files that the path names; those over the cap keep a null content, which is not read and becomes an error."""
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= limits.max_input_bytes).select("path", "content", "length")
    large = files.filter(F.col("length") > limits.max_input_bytes).select("path", F.lit(None).cast("binary").alias("content"), "length")
    return small.unionByName(large)


def to_json(results: DataFrame) -> DataFrame:
    """One JSON document a result."""
    return results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def from_json(rows: DataFrame, value: str = "value") -> DataFrame:
    from quirelake.schema import EXTRACTION

    return rows.select(F.from_json(value, EXTRACTION).alias("r")).select("r.*")


def options_json(limits: Limits) -> str:
    from dataclasses import asdict

    return json.dumps(asdict(limits), sort_keys=True)
