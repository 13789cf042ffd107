"""Queries that read whole formats back: what was put in must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.layout.plan import render_pages
from quirelake.plans import fixtures
from quirelake.sources.extract import extract, from_json, to_json


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("name"))


def eml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages, every third in an alternative with HTML."""
    body = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    head = F.concat(F.lit("From: writer@example.org\r\nTo: reader@example.org\r\nSubject: "), F.col("name"), F.lit("\r\nDate: Tue, 05 Mar 2024 10:00:00 +0100\r\nMIME-Version: 1.0\r\n"))
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), body)
    both = F.concat(F.lit('Content-Type: multipart/alternative; boundary="=b="\r\n\r\n--=b=\r\n'), plain, F.lit("\r\n--=b=\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>other</p>\r\n--=b=--\r\n"))
    raw = F.concat(head, F.when(F.col("turn") % 3 == 0, both).otherwise(plain)).cast("binary")
    files = _turns(spark, sf_dir).select(F.concat(F.lit("mail/"), F.col("name"), F.lit(".eml")).alias("path"), raw.alias("content"))
    out = extract(files)
    return out.select(F.col("metadata.title").alias("title"), F.col("metadata.author").alias("author"), F.col("metadata.created").alias("created"), F.sha2("content.text", 256).alias("text_sha256"), F.col("error.kind").alias("error"))


def rtf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.split(F.concat(F.col("text"), F.lit(" {x}\\ ")), "")
    coded = F.transform(
        chars,
        lambda c: F.when(c == "\n", F.lit("\\par ")).when(c.isin("{", "}", "\\"), F.concat(F.lit("\\"), c)).when(F.ascii(c) > 127, F.concat(F.lit("\\u"), F.ascii(c).cast("string"), F.lit("?"))).otherwise(c),
    )
    raw = F.concat(F.lit("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}\\uc1 "), F.array_join(coded, ""), F.lit("}"))
    files = _turns(spark, sf_dir).select(F.concat(F.col("name"), F.lit(".rtf")).alias("path"), raw.cast("binary").alias("content"))
    out = extract(files)
    return out.select(F.col("source.filename").alias("filename"), F.sha2("content.text", 256).alias("text_sha256"), F.col("error.kind").alias("error"))


def docx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as documents with a heading and a table of their words."""
    cells = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    files = _turns(spark, sf_dir).select(F.concat(F.col("name"), F.lit(".docx")).alias("path"), fixtures.docx_bytes("name", "text", cells).alias("content"))
    out = extract(files)
    table = F.get("content.tables", F.lit(0))
    return out.select(
        F.col("metadata.title").alias("title"),
        F.get("content.sections", F.lit(0))["heading"].alias("heading"),
        F.sha2(F.regexp_replace("content.text", r"\n+", "\n"), 256).alias("text_sha256"),
        F.array_join(table["headers"], "|").alias("headers"),
        F.array_join(F.transform(table["rows"], lambda r: F.array_join(r, "|")), ";").alias("rows"),
    )


def pdf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, a page for up to three line items each."""
    li = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    item = F.struct("l_linenumber", "l_partkey", F.concat(F.lit("("), F.col("p_name"), F.lit(") "), F.col("l_linenumber").cast("string")).alias("t"))
    orders = li.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]).alias("lines"))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 3).cast("int")), lambda k: F.slice("lines", k * 3 + 1, 3))
    title = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"))
    out = extract(orders.select(F.concat(F.col("l_orderkey").cast("string"), F.lit(".pdf")).alias("path"), fixtures.pdf_bytes(title, pages).alias("content")))
    return out.select(F.col("metadata.title").alias("title"), F.col("metadata.created").alias("created"), F.col("metadata.page_count").cast("long").alias("pages"), F.sha2("content.text", 256).alias("text_sha256"))


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of each region in a table: with thead, with a row of th, or bare; one row is too short, one too long; an empty table goes before."""
    cell = lambda t, c: F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))
    k = F.col("n_nationkey")
    row = F.concat(
        F.lit("<tr>"), cell("td", F.col("n_name")), F.when(k % 5 == 1, F.lit("")).otherwise(cell("td", F.concat(F.lit(" <b>"), k.cast("string"), F.lit("</b>\n "))))
        , F.when(k % 5 == 2, cell("td", F.lit("extra"))).otherwise(""), F.lit("</tr>"),
    )
    body = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]), "").alias("body"))
    r = F.col("n_regionkey")
    head = F.when(r % 3 == 0, F.lit("<thead><tr><th>name</th><th>key</th></tr></thead><tbody>")).when(r % 3 == 1, F.lit("<tr><th>name</th><th>key</th></tr>")).otherwise(F.lit("<tr><td>name</td><td>key</td></tr>"))
    html = F.concat(F.lit("<html><body><table></table><table>"), head, F.col("body"), F.when(r % 3 == 0, F.lit("</tbody>")).otherwise(""), F.lit("</table></body></html>"))
    out = extract(body.select(F.concat(r.cast("string"), F.lit(".html")).alias("path"), html.cast("binary").alias("content")))
    rows = out.select("source.filename", F.explode("content.tables").alias("t")).select("filename", F.col("t.client_table_hint").alias("hint"), F.array_join("t.headers", "|").alias("headers"), F.posexplode("t.rows").alias("row", "cells"))
    return rows.select("filename", "hint", "headers", F.col("row").cast("long").alias("row"), F.array_join("cells", "|").alias("cells"))


def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through the HTML reader: text nodes, title, language, word count, fingerprint."""
    files = _table(spark, sf_dir, "pages").select(F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    out = extract(files, bare_references=False)
    return out.select(
        F.col("source.path").alias("path"), F.col("source.sha256").alias("sha256"), F.col("source.size_bytes").alias("size_bytes"), F.col("metadata.language").alias("language"), F.sha2("content.text", 256).alias("text_sha256"), F.col("metadata.word_count").alias("words")
    )


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts extracted, written as JSON and read again."""
    files = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    out = from_json(to_json(extract(files, emit_sentences=True)))
    return out.select(F.col("source.path").alias("path"), F.col("spec_version"), F.sha2("content.text", 256).alias("text_sha256"), F.size("content.sentences").cast("long").alias("sentences"), F.size("warnings").cast("long").alias("warnings"))


def markdown_from_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as small pages: heading, emphasis, list, a safe and an unsafe link, script and image."""
    c = _table(spark, sf_dir, "customer")
    html = F.concat(
        F.lit("<html><head><title>t</title></head><body><h2>"), F.col("c_name"), F.lit("</h2><p onclick='x()'>in <b>"), F.col("c_mktsegment"),
        F.lit("</b>, see <a href='https://example.org/a'>here</a> or <a href='javascript:alert(1)'>there</a></p><script>alert(2)</script><ul><li>one</li><li>two</li></ul><img src='x' alt='"), F.col("c_name"), F.lit("'></body></html>"),
    )
    out = extract(c.select(F.concat(F.col("c_custkey").cast("string"), F.lit(".html")).alias("path"), html.cast("binary").alias("content")))
    return out.select(F.col("source.filename").alias("filename"), F.col("content.markdown").alias("markdown"), F.array_join("warnings", "; ").alias("warnings"))


def layout_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables recovered from word boxes: an order a page, part names at the left, two columns of amounts under years."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    li = _table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    listed = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", "p_name"))).alias("l")).filter(F.size("l") >= 3)
    amount = lambda c: F.concat(F.floor(c).cast("string"), F.lit(".00"))
    rows = listed.select("l_orderkey", F.posexplode("l").alias("k", "i"))
    box = lambda text, x, right: F.struct(text.alias("text"), (x - F.length(text) * 5.0 if right else F.lit(x)).alias("x0"))
    name = F.split("i.p_name", " ")
    before = lambda j: F.length(F.array_join(F.transform(F.slice(name, F.lit(1), j), lambda w: F.concat(w, F.lit(" "))), ""))
    label = F.transform(name, lambda w, j: F.struct(w.alias("text"), (F.lit(50.0) + before(j) * 5.0).alias("x0")))
    boxes = F.concat(label, F.array(box(amount(F.col("i.l_extendedprice")), 420.0, True), box(amount(F.col("i.l_extendedprice") / 3), 540.0, True)))
    body = rows.select("l_orderkey", (F.col("k") * 16 + 100.0).alias("y0"), F.explode(boxes).alias("b"))
    head = F.array(box(F.lit("Item"), 50.0, False), box(F.lit("2023"), 420.0, True), box(F.lit("2022"), 540.0, True))
    words = body.unionByName(listed.select("l_orderkey", F.lit(84.0).alias("y0"), F.explode(head).alias("b")))
    words = words.select(
        F.floor(F.col("l_orderkey") / 50).alias("doc"), F.col("l_orderkey").alias("page"), "b.x0", "y0", (F.col("b.x0") + F.length("b.text") * 5.0).alias("x1"), (F.col("y0") + 10).alias("y1"),
        F.col("b.text").alias("text"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"), F.lit(False).alias("rotated"),
    )
    found = render_pages(words, "doc", "page").select("page", "n_tables", F.explode(F.split("text", "\n")).alias("line"))
    return found.filter(F.col("line").contains("2023: ")).select("page", F.col("n_tables").cast("long").alias("n_tables"), "line")


QUERIES = {f.__name__: f for f in (eml_roundtrip, rtf_roundtrip, docx_roundtrip, pdf_roundtrip, html_tables, html_extract, json_roundtrip, markdown_from_html, layout_tables)}

_TURN = r"t as (select conv_id, turn, 'c' || conv_id || '_' || turn as name, coalesce(text, '') as text from conversations)"
_CANON = r"regexp_replace(regexp_replace(regexp_replace({}, '[ \t]+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"

ORACLE_SQL = {
    "eml_roundtrip": f"with {_TURN} select name as title, 'writer@example.org' as author, '2024-03-05T10:00:00+01:00' as created, sha256({_CANON.format('text')}) as text_sha256, null::varchar as error from t",
    "rtf_roundtrip": f"with {_TURN} select name || '.rtf' as filename, sha256(" + _CANON.format("text || ' {x}\\'") + ") as text_sha256, null::varchar as error from t",
    "docx_roundtrip": rf"""
        with {_TURN}, w as (select *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from t)
        select name as title, name as heading, sha256(regexp_replace(trim(regexp_replace(name || chr(10) || text, '[ \t]+(\n|$)', '\1', 'g'), chr(10)), '\n+', chr(10), 'g')) as text_sha256,
               case when len(w) > 0 then 'key|value' end as headers, case when len(w) > 0 then array_to_string(list_transform(w, lambda x, i: (i - 1) || '|' || x), ';') end as rows from w""",
    "pdf_roundtrip": """
        with l as (select l_orderkey, '(' || p_name || ') ' || l_linenumber as t, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, '(' || p_name) - 1 as k from lineitem join part on p_partkey = l_partkey),
        p as (select l_orderkey, k // 3 as p, string_agg(t, chr(10) order by k) as t from l group by all)
        select 'order ' || l_orderkey as title, '2024-03-05T10:00:00Z' as created, count(*)::bigint as pages, sha256(string_agg(t, chr(10) || chr(10) order by p)) as text_sha256 from p group by l_orderkey""",
    "html_tables": """
        select n_regionkey || '.html' as filename, 'html_dom_t1' as hint, 'name|key' as headers, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::bigint as row,
               n_name || '|' || case when n_nationkey % 5 = 1 then '' else n_nationkey::varchar end as cells from nation""",
    "html_extract": r"""
        with a as (select page_id, html, regexp_replace(regexp_replace(html, '<!--(.|\n)*?-->', chr(1), 'g'), '(?i)<(script)\b(.|\n)*?</script[^>]*>|<(style)\b(.|\n)*?</style[^>]*>|<(head)\b(.|\n)*?</head[^>]*>|<(title)\b(.|\n)*?</title[^>]*>', chr(1), 'g') as h from pages),
        b as (select page_id, html, list_filter(list_transform(string_split(regexp_replace(h, '<[^<>]*>', chr(1), 'g'), chr(1)),
          lambda x: regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') as n from a),
        c as (select page_id, html, regexp_replace(array_to_string(n, chr(10)), '\n{3,}', chr(10) || chr(10), 'g') as t from b)
        select 'web/' || page_id || '.html' as path, sha256(html) as sha256, strlen(html)::bigint as size_bytes, nullif(regexp_extract(html, '(?i)<html[^>]*lang="([A-Za-z0-9-]+)', 1), '') as language,
               sha256(t) as text_sha256, len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> ''))::bigint as words from c""",
    "markdown_from_html": """
        select c_custkey || '.html' as filename, '## ' || c_name || chr(10) || chr(10) || 'in **' || c_mktsegment || '**, see [here](https://example.org/a) or there' || chr(10) || chr(10) || '- one' || chr(10) || '- two' || chr(10) || chr(10) || c_name as markdown,
               'markdown: 1 event attributes removed; markdown: 1 images removed; markdown: 1 tag script removed; markdown: 1 url javascript removed' as warnings from customer""",
    "layout_tables": """
        with l as (select *, count(*) over (partition by l_orderkey) as n from lineitem join part on p_partkey = l_partkey)
        select l_orderkey as page, 1::bigint as n_tables, p_name || ' | 2023: ' || floor(l_extendedprice)::bigint || '.00 | 2022: ' || floor(l_extendedprice / 3)::bigint || '.00' as line from l where n >= 3""",
}


def _json_sql() -> str:
    from quirelake.plans.document_queries import _SENTENCES_SQL

    return f"with {_SENTENCES_SQL}, n as (select doc_id, count(*) as n from sen group by 1)" + """
        select 'd/' || d.doc_id || '.txt' as path, '1.3.0' as spec_version, sha256(text) as text_sha256, coalesce(n, 0)::bigint as sentences, 0::bigint as warnings from documents d left join n using (doc_id)"""


ORACLE_SQL["json_roundtrip"] = _json_sql()
