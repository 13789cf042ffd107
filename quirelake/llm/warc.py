"""WARC archives: written from captures, read back, and assembled to one row a capture.

Spark's text writer lays records down: a record is a string and the writer's line separator the two line
breaks that end a record, so that archives go wherever Spark can write, with its commit protocol.
A capture is a request, a response (or a revisit of an earlier one's payload) and a metadata
record, the first and last naming the response's record in WARC-Concurrent-To.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import checkpoint_folder, cut_lineage, in_arrow, join_names

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_EOL = "\r\n"
_REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Digests with copies up to which their table is broadcast; beyond, the most frequent digests alone are, and other captures are shuffled.
SMALL_ROWS = 200_000
#: Bytes of payload that an archive holds on average at most, as readers take it whole.
ARCHIVE_BYTES = 32 << 20


def base32_sha1(text: Column) -> Column:
    """Base32 of the SHA-1 of the text's UTF-8: every five hex digits are four letters."""
    digest = F.sha1(text.cast("binary"))

    def letters(i: Column) -> Column:
        value = F.conv(F.substring(digest, i, F.lit(5)), 16, 10).cast("int")
        picks = [F.substring(F.lit(_ALPHABET), F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
        return F.concat(*picks)

    return F.concat(*(letters(F.lit(1 + 5 * k)) for k in range(8)))


def _fields(**fields: Column | str | None) -> Column:
    """Header lines; fields whose value is null are left out."""
    lines = [F.concat(F.lit(f"{k.replace('_', '-')}: "), F.lit(v) if isinstance(v, str) else v, F.lit(_EOL)) for k, v in fields.items()]
    return F.concat(*(F.coalesce(x, F.lit("")) for x in lines))


def _record(block: Column, **fields: Column | str) -> Column:
    return F.concat(F.lit(f"WARC/1.0{_EOL}"), _fields(**fields, Content_Length=F.octet_length(block).cast("string")), F.lit(_EOL), block)


def write_archives(
    captures: DataFrame, folder: str, key: str, url: str, payload: str, revisit_bytes: int = 0, date: str = "2026-01-01T00:00:00Z", records_per_file: int | None = None, urn: str = "urn:capture"
) -> None:
    """Archives, gzip-compressed, of one request, response or revisit, and metadata record a row.

    Of rows with equal payloads of revisit_bytes or more, those with the smallest key are responses and the others revisit; a null
    key is smaller than none, and among nulls alone all are responses. A null payload is empty; a null URL is left out, white space and
    controls in one are percent-encoded. Record ids are made of key and digest, so that repeated
    rows repeat their ids. An empty table leaves a folder without records. Without records_per_file archives are cut by ARCHIVE_BYTES.
    """
    text = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = captures.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), text.alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    rows = rows.withColumn("bytes", F.octet_length("payload"))
    copies = rows.filter(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = cut_lineage(copies.filter("n > 1 and first is not null"))
    if copies.count() <= SMALL_ROWS:
        rows = rows.join(F.broadcast(copies.drop("n")), "digest", "left")
    else:
        rows = join_names(rows, copies, "digest", "left")
    if records_per_file is None:
        size = captures.agg(F.avg(F.octet_length(F.col(f"`{payload}`")) + 1000)).first()[0] or 1000
        records_per_file = 3 * max(1, int(ARCHIVE_BYTES / size))
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    name = lambda k, kind: F.concat(F.lit(f"<{urn}:"), F.coalesce(k.cast("string"), F.lit("")), F.lit(":"), F.col("digest"), F.lit(f":{kind}>"))
    own = name(F.col("key"), "response")
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    target = F.regexp_extract(uri, r"^[^:]*://[^/?#]*([^#]*)", 1)
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}"), _fields(Content_Type="text/html; charset=utf-8", Content_Length=F.col("bytes").cast("string")), F.lit(_EOL))
    ask = F.concat(F.lit("GET "), F.coalesce(F.nullif(target, F.lit("")), F.lit("/")), F.lit(f" HTTP/1.1{_EOL}"), _fields(Host=F.nullif(F.regexp_extract(uri, r"://([^/?#]*)", 1), F.lit(""))), F.lit(_EOL))
    told = _fields(payload_length=F.col("bytes").cast("string"), payload_digest=F.col("digest"))
    shared = {"WARC_Date": date, "WARC_Target_URI": uri}
    answer = {"WARC_Payload_Digest": F.concat(F.lit("sha1:"), F.col("digest")), "Content_Type": "application/http; msgtype=response"}
    response = F.when(
        again, _record(head, WARC_Type="revisit", WARC_Record_ID=own, WARC_Refers_To=name(F.col("first"), "response"), WARC_Profile=_REVISIT, **shared, **answer)
    ).otherwise(_record(F.concat(head, F.col("payload")), WARC_Type="response", WARC_Record_ID=own, **shared, **answer))
    request = _record(ask, WARC_Type="request", WARC_Record_ID=name(F.col("key"), "request"), WARC_Concurrent_To=own, Content_Type="application/http; msgtype=request", **shared)
    metadata = _record(told, WARC_Type="metadata", WARC_Record_ID=name(F.col("key"), "metadata"), WARC_Concurrent_To=own, Content_Type="application/warc-fields", **shared)
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", _EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(folder)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased headers, block) of each record of an archive, compressed or not; ValueError where it breaks off."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:20]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", "0"))
        if size < 0:
            raise ValueError(f"a record of {size} bytes")
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record breaks off")
        yield headers, block


_SCHEMA = "kind string, id string, concurrent_to string, refers_to string, uri string, date string, digest string, payload_bytes long, measured_digest string, payload binary, fields map<string,string>"


def read_records(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row a record of the folder's archives. Responses have their payload measured and hashed; metadata and requests give fields.

    An archive that breaks off or is none gives the records in front and a row of kind `error`, whose fields name the file and what is wrong.
    """
    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select("path", "content")

    def row(headers: dict[str, str], block: bytes) -> dict:
        kind, size, measured, body, fields = headers.get("warc-type", ""), None, None, None, None
        if kind == "response":
            body = block.partition(b"\r\n\r\n")[2]
            size, measured = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
        elif kind == "metadata":
            lines = block.decode("utf-8", "replace").split(_EOL)
            fields = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines if x)]
        elif kind == "request":
            fields = [("request", block.split(b"\r\n", 1)[0].decode("utf-8", "replace"))]
        get = headers.get
        return {
            "kind": kind, "id": get("warc-record-id"), "concurrent_to": get("warc-concurrent-to"), "refers_to": get("warc-refers-to"), "uri": get("warc-target-uri"), "date": get("warc-date"),
            "digest": (get("warc-payload-digest") or "").rpartition(":")[2] or None, "payload_bytes": size, "measured_digest": measured, "payload": body if with_payload else None, "fields": fields,
        }

    kinds = [(n, pa.string()) for n in ("kind", "id", "concurrent_to", "refers_to", "uri", "date", "digest")]
    kinds += [("payload_bytes", pa.int64()), ("measured_digest", pa.string()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows: list[dict] = []
                held = 0
                try:
                    for headers, block in parse_records(content.as_py()):
                        rows.append(row(headers, block))
                        held += len(block) if with_payload else 0
                        if len(rows) >= 10_000 or held > 32 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))
                            rows, held = [], 0
                except (ValueError, EOFError, OSError, zlib.error) as e:
                    rows.append({"kind": "error", "fields": [("file", path.as_py()), ("error", str(e))]})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return in_arrow(files, run, _SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: id, response, request and metadata (structs; null where there is none).

    Records other than responses and revisits belong to the record they name in concurrent_to, or to the one
    that this names in turn. Each response or revisit is a capture, repeated ids included; of several
    requests or metadata records of a capture the one with the smallest id stands. Records that lead to no response are a
    capture without one under the id they name. Error rows are left out. records is read three times: cut its lineage where it is costly.
    """
    main = records.filter("kind in ('response', 'revisit')")
    other = records.filter("kind not in ('response', 'revisit', 'warcinfo', 'error')").select("kind", "id", "concurrent_to", "uri", "fields")
    steps = other.filter("concurrent_to is not null").groupBy(F.col("id").alias("step")).agg(F.min("concurrent_to").alias("leads_to"))
    other = other.join(steps, other.concurrent_to == steps.step, "left").withColumn("root", F.coalesce("leads_to", "concurrent_to", "id"))
    part = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.struct("id", "uri", "fields")), F.when(F.col("kind") == kind, F.col("id"))).alias(kind)
    parts = other.groupBy("root").agg(part("request"), part("metadata"))
    whole = main.select("id", F.struct("kind", "uri", "date", "digest", "refers_to", "payload_bytes", "measured_digest", "payload").alias("response"))
    joined = whole.join(parts, whole.id == parts.root, "left").select("id", "response", "request", "metadata")
    orphans = parts.join(main.select(F.col("id").alias("root")), "root", "left_anti")
    return joined.unionByName(orphans.select(F.col("root").alias("id"), F.lit(None).cast(whole.schema["response"].dataType).alias("response"), "request", "metadata"))


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below the session's checkpoint folder, which driver and executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


ORACLE = r"""
with p as (select page_id, coalesce(html, '') as x from pages),
d as (select page_id, strlen(x)::bigint as payload_bytes, sha1(x) as h from p),
b as (
  select page_id, payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * (i // 4) + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), '') as payload_digest
  from d
), f as (select *, min(page_id) over (partition by payload_digest) as first from b)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from f
"""
