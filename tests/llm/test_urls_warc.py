"""URL rules against plain loops; WARC records against their payloads."""

import base64
import gzip
import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from quirelake.llm import queries, urls, warc

URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "https://EXAMPLE.org/es/x", "https://a.b.example.org/en/123?q#f", "https://example.org/en/2", "http://xample.org/en/1", "http://notexample.org/es/",
    "ftp://x.com/fr/a", "http://x.com/de/", "http://x.com/d", "http://x.com?/de/", "http://x.com#/fr/", "a://b://c.com/de/", "http://com/fr/", "http://.com/fr/", "http://x.com:80/fr/", "http://É.ORG/\n/x",
]


def plain_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0] or [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = rest[: min([i for i in map(rest.find, "?#") if i >= 0] or [len(rest)])]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), len(r.host)), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_rules(spark, sf):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows = [*pages, *((10_000 + i, u) for i, u in enumerate(URLS)), (None, URLS[6]), (10_000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("html", F.lit("x")).withColumn("host", F.lit("y"))
    for rules in (queries.RULES, [], [urls.Rule("a.com", "/b", "block"), urls.Rule("com", "/bcc", "allow"), urls.Rule("example.org", "", "block")]):
        want = sorted((str(i), *map(str, plain_judge(u, rules))) for i, u in rows)
        for bound in (urls.MAX_BYTES, 60):  # the second is over the bound of a broadcast: dealt to shards
            got = urls.filter_urls(df, rules, ["page_id"], max_bytes=bound).collect()
            assert sorted((str(r.page_id), *map(str, (r.host, r.path, r.rule, r.verdict))) for r in got) == want
    assert urls.filter_urls(df.limit(0), queries.RULES, ["page_id"]).count() == 0
    with pytest.raises(ValueError, match="clash"):
        urls.filter_urls(df, queries.RULES, ["host"])


def test_collisions_are_confirmed(monkeypatch):
    """With digests of two bits, only the stored strings tell keys apart."""
    real = xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x: real(x) & 3)
    rules = [urls.Rule(f"h{i}.org", f"/{i}", "block") for i in range(50)]
    prober = urls.Prober(urls.build_index(rules))
    hosts, paths = [f"x.h{i % 60}.org" for i in range(120)], [f"/{i}/a" for i in range(120)]
    got = prober.judge(hosts, paths)
    for h, p, g in zip(hosts, paths, got, strict=True):
        want = plain_judge(f"http://{h}{p}", rules)
        assert (g and g[0]) == want[2]


PAYLOADS = [None, "", "same", "same", "other \r\n\r\nWARC/1.0\r\n\r\n", "é" * 70_000, "same", "\r\n\r\n", "\x00\x01", ""]


def plain_captures(rows, least):
    out = []
    for k, p in rows:
        b = (p or "").encode()
        first = min((q for q, x in rows if q is not None and (x or "").encode() == b), default=None)
        again = len(b) >= least and first is not None and k != first
        out.append((k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 5])
def test_captures_come_back(spark, least, monkeypatch):
    rows = [(i, p) for i, p in enumerate(PAYLOADS)] + [(3, "same"), (None, "alone"), (40, "other")]
    df = spark.createDataFrame([(k, f"http://h/{k} x\n" if k != 4 else None, p) for k, p in rows], "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("bytes", F.lit(1))
    for small in (warc.SMALL_ROWS, -1):
        monkeypatch.setattr(warc, "SMALL_ROWS", small)
        folder = warc.shared_folder(spark)
        warc.write_archives(df, folder, "page_id", "url", "html", revisit_bytes=least, records_per_file=7)
        got = warc.assemble(warc.read_records(spark, folder, with_payload=True)).collect()
        page = lambda x: int(x.split(":")[2]) if x and x.split(":")[2] else None
        found = []
        for c in got:
            size = c.response.payload_bytes if c.response.kind == "response" else int(c.metadata.fields["payload-length"])
            found.append((page(c.id), size, c.response.measured_digest or c.response.digest, c.response.kind, page(c.response.refers_to)))
            assert c.request.fields["request"].startswith("GET ") and c.metadata is not None
            if c.response.kind == "response":
                assert bytes(c.response.payload).decode() in {p or "" for _, p in rows}
        assert sorted(map(str, found)) == plain_captures(rows, least)
        warc.delete_folder(spark, folder)


def test_empty_table(spark):
    folder = warc.shared_folder(spark)
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder, "page_id", "url", "html")
    assert warc.assemble(warc.read_records(spark, folder)).count() == 0


def test_records_of_any_archive():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    member = gzip.compress(record)
    assert [b for _, b in warc.parse_records(member + member)] == [b"ab\r\n"] * 2
    assert [b for _, b in warc.parse_records(record)] == [b"ab\r\n"]
    with pytest.raises(ValueError, match="breaks off"):
        list(warc.parse_records(record[:-7]))
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse_records(b"junk\r\n"))


def test_assembly_follows_links(spark):
    """Metadata that names the request, a capture without a response, and two requests."""
    kind = "kind string, id string, concurrent_to string, uri string, date string, digest string, refers_to string, payload_bytes long, measured_digest string, payload binary, fields map<string,string>"
    none = [None] * 7
    rows = [
        ("response", "r1", None, "u", *none), ("request", "q1", "r1", "u", *none), ("metadata", "m1", "q1", "u", *none), ("request", "q0", "r1", "u", *none),
        ("request", "q9", "r9", "u", *none), ("warcinfo", "i", None, None, *none), ("metadata", "m7", None, "u", *none),
    ]
    got = {c.id: c for c in warc.assemble(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {"r1", "r9", "m7"}
    assert got["r1"].request.id == "q0" and got["r1"].metadata.id == "m1"
    assert got["r9"].response is None and got["r9"].request.id == "q9" and got["m7"].metadata.id == "m7"


def test_a_broken_archive_is_a_row(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r1>\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    odd = {"good": record, "cut": gzip.compress(record * 3)[:-20], "off": record + record[:-7], "junk": b"junk\r\n", "length": record.replace(b": 4", b": x"), "minus": record.replace(b": 4", b": -4")}
    for name, data in odd.items():
        (tmp_path / name).write_bytes(data)
    got = warc.read_records(spark, str(tmp_path)).collect()
    assert {r.fields["file"].rpartition("/")[2] for r in got if r.kind == "error"} == set(odd) - {"good"}
    assert sum(r.kind == "response" for r in got) >= 2
    assert {c.id for c in warc.assemble(warc.read_records(spark, str(tmp_path))).collect()} == {"<r1>"}
