"""Queries of the scalar text operators, on driver tables with the features to be exercised put in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import detect
from quirelake.schema import Limits


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing blanks, CRLF and runs of empty lines are put in before."""
    raw = F.concat(F.lit("\r\n  "), F.replace("text", F.lit("\n"), F.lit(" \t\r\n\r\n\r")), F.lit("  \r\n\r\n\r\n"), F.col("lang"), F.lit(" \r"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.canonicalize(raw, nfc=True), 256).alias("sha256"))


def canonicalize_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = T.canonicalize(F.col("text"))
    return _docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(T.canonicalize(once) != once).cast("long").alias("changed"))


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("words"), F.length("text").cast("long").alias("chars"))


def est_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.est_tokens(F.col("text")).alias("tokens"))


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    plain = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    kind = F.col("l_linenumber") % 5
    token = (
        F.when(kind == 0, plain)
        .when(kind == 1, F.concat(F.lit("CHF "), plain))
        .when(kind == 2, F.date_format("l_shipdate", "dd.MM.yyyy"))
        .when(kind == 3, F.concat(F.col("l_returnflag"), F.lit("nr"), F.col("l_quantity").cast("long").cast("string")))
        .otherwise(F.concat(F.floor(cents / 100).cast("string"), F.lit("%")))
    )
    return rows.select("l_orderkey", "l_linenumber", token.alias("token"))


def token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("token")
    return (
        _amounts(spark, sf_dir)
        .groupBy(
            (F.col("l_linenumber") % 5).cast("long").alias("kind"), T.is_amount(t).alias("amount"), T.is_dateyear(t).alias("dateyear"), T.is_numlike(t).alias("numlike"), T.has_letters(t).alias("letters")
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


_TOKENS_SQL = r"""
t as (
  select l_linenumber, l_orderkey, case l_linenumber % 5
    when 0 then (c // 100)::varchar || '.' || lpad((c % 100)::varchar, 2, '0')
    when 1 then 'CHF ' || (c // 100)::varchar || '.' || lpad((c % 100)::varchar, 2, '0')
    when 2 then strftime(l_shipdate, '%d.%m.%Y')
    when 3 then l_returnflag || 'nr' || l_quantity::bigint::varchar
    else (c // 100)::varchar || '%' end as token
  from (select *, round(l_extendedprice * 100)::bigint as c from lineitem)
)
"""


def clean_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" |\t"), F.replace("text", F.lit(" "), F.lit(" |  ")), F.lit("\n "))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.clean_cell(raw), 256).alias("sha256"))


def row_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.replace("text", F.lit("\n"), F.lit("\t "))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.lint_row(raw), 256).alias("sha256"))


_HOSTILE = (("", ""), ("‮", ""), ("\x1b[2J", ""), ("  ", "\t "), ("\x9b", "x"), ("long", ""))


def sanitize_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % len(_HOSTILE)
    raw = F.element_at(F.array(*[F.concat(F.lit(a), F.col("text"), F.lit(b)) for a, b in _HOSTILE[:-1]], F.concat(F.col("text"), F.repeat(F.lit("x"), 5000))), (k + 1).cast("int"))
    raw = F.regexp_replace(raw, "\n", " ")
    return _docs(spark, sf_dir).select("doc_id", T.sanitize_scalar(raw).alias("s")).select("doc_id", F.sha2(F.col("s.value"), 256).alias("value_sha256"), F.col("s.category").alias("category"))


_SANITIZE_SQL = r"""
with r as (
  select doc_id, regexp_replace(case doc_id % 6 when 0 then text when 1 then chr(8238) || text when 2 then chr(27) || '[2J' || text
    when 3 then '  ' || text || chr(9) || ' ' when 4 then chr(155) || text || 'x' else text || repeat('x', 5000) end, '\n', ' ', 'g') as v from documents
), s as (select doc_id, regexp_replace(regexp_replace(v, '^[ \t]+', ''), '[ \t]+$', '') as v from r)
select doc_id, case when doc_id % 6 in (1, 2, 4) or v = '' then null else sha256(left(v, 4096)) end as value_sha256,
       case when doc_id % 6 in (1, 2, 4) then 'control_chars' when length(v) > 4096 then 'truncated' end as category
from s
"""


def metadata_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize_scalar(spark, sf_dir).filter("category is not null").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def path_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    path = F.concat(F.lit("in/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    path = (
        F.when(k == 1, F.concat(path, F.lit("⁦x")))
        .when(k == 2, F.concat(path, F.lit("\x07")))
        .when(k == 3, F.concat(path, F.repeat(F.lit("y"), Limits.max_path_length)))
        .when(k == 4, F.concat(path, F.lit("\ttab")))
        .otherwise(path)
    )
    return _docs(spark, sf_dir).select("doc_id", T.path_error(path).alias("error"))


def pdf_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    raw = (
        F.when(k == 0, F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("+02'00'")))
        .when(k == 1, F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMdd")))
        .when(k == 2, F.date_format(ts, "yyyyMMddHHmm"))
        .when(k == 3, F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("Q9")))
        .otherwise(F.lit("gestern"))
    )
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", T.pdf_date(raw).alias("iso"))


def perm_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", T.permissions((F.col("o_orderkey") % 4096).cast("int")).alias("rights"))


def plural(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("conv_id", T.counted(F.col("n") - 2, "page").alias("told"))


def url_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 7
    url = (
        F.when(k == 1, F.concat(F.lit("javascript:"), F.col("url")))
        .when(k == 2, F.regexp_replace("url", "^https?:", ""))
        .when(k == 3, F.lit(" /relative/path "))
        .when(k == 4, F.upper("url"))
        .when(k == 5, F.lit("mailto:a@example.org"))
        .when(k == 6, F.lit("  "))
        .otherwise(F.col("url"))
    )
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.metadata_url_ok(url).alias("metadata_ok"), T.markdown_url_ok(url).alias("markdown_ok"))


_MARKS = (("", ""), ("(cid:12)(cid:7) ", ""), ("�� ", ""), ("", " bcdfghjklm"), ("", ""), ("¤¤¤¤ ¶¶¶¶ ", ""))


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as layers, with unmapped glyphs and consonant runs put in, and an image cover; under ids below zero short layers of up to 160 characters, some empty."""
    k = (F.col("doc_id") % len(_MARKS) + 1).cast("int")
    size = (F.col("doc_id") % 9 * 20).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(m[i]) for m in _MARKS]), k)
    layer = lambda text: F.concat(pick(0), F.replace(text, F.lit("\n"), F.lit(" ")), pick(1))
    short = F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(layer(F.substring(F.col("text"), F.lit(1), size)))
    both = F.array(F.struct(F.col("doc_id").alias("id"), layer(F.col("text")).alias("layer")), F.struct((-1 - F.col("doc_id")).alias("id"), short.alias("layer")))
    rows = _docs(spark, sf_dir).select((F.col("doc_id") % 21 / 20.0).alias("cover"), F.inline(both))
    return rows.select(F.col("id").alias("doc_id"), "layer", "cover")


def layer_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layers(spark, sf_dir).select("doc_id", T.layer_is_garbage(F.col("layer")).alias("garbage"), T.layer_is_usable(F.col("layer")).alias("usable"))


def ocr_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _layers(spark, sf_dir).select("doc_id", *[T.decide_page(F.col("layer"), F.col("cover"), u).alias(u) for u in ("auto", "always", "never")])
    return rows.select("doc_id", F.col("auto.needs_ocr").alias("needs_ocr"), F.col("auto.keep_text_layer").alias("keep_text_layer"), F.col("auto.reason").alias("reason"), F.col("always.reason").alias("always"), F.col("never.reason").alias("never"))


_LAYERS_SQL = r"""
l as (
  select case when short then -1 - doc_id else doc_id end as doc_id, case when short and doc_id % 11 = 0 then '' else
    ['', '(cid:12)(cid:7) ', chr(65533) || chr(65533) || ' ', '', chr(57344), '¤¤¤¤ ¶¶¶¶ '][(doc_id % 6 + 1)::int]
    || replace(case when short then left(text, (doc_id % 9 * 20)::int) else text end, chr(10), ' ') || ['', '', '', ' bcdfghjklm', '', ''][(doc_id % 6 + 1)::int] end as layer,
    (doc_id % 21) / 20.0::double as cover
  from documents, (values (false), (true)) as v(short)
), k as (
  select *, regexp_replace(regexp_replace(layer, '^\s+', ''), '\s+$', '') as s, list_filter(string_split_regex(layer, '\s+'), lambda w: w <> '') as w,
         len(regexp_extract_all(layer, '\(cid:\d+\)|\x{FFFD}|[\x{E000}-\x{F8FF}]')) as marks
  from l
), g as (
  select *, list_filter(w, lambda x: length(x) >= 4) as long from k
), b as (
  select *, len(list_filter(long, lambda x: case
      when contains(x, '(cid:') or regexp_matches(x, '[\x{FFFD}\x{E000}-\x{F8FF}]') then true
      when regexp_full_match(x, '[\d''’.,:/%+\-()\[\]]*\d[\d''’.,:/%+\-()\[\]]*') then false
      else (not regexp_matches(x, '[\p{L}\p{Nd}]')) or len(regexp_extract_all(x, '[^\p{L}\p{Nd}.,;:!?''"()\[\]{}\-–—/\\&%+*=<>#@§°_|~`´^’“”„«»…·•]')) / length(x)::double > 0.3
           or (len(regexp_extract_all(x, '\p{L}')) >= 8 and not regexp_matches(lower(x), '[aeiouyäöüéèêàâôûïîœæø]')) end)) as bad
  from g
), v as (
  select *, len(w) > 0 and (marks / greatest(len(w), 1)::double > 0.05 or bad / greatest(len(long), 1)::double > 0.15) as garbage,
         len(list_filter(w, lambda x: len(regexp_extract_all(x, '\p{L}')) >= 2)) as alphabetic
  from b
), u as (select *, length(s) >= 20 and not garbage and alphabetic >= 2 as usable from v)
"""


def mime_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the formats in front of each text, under names with and without a known suffix."""
    k = (F.col("doc_id") % 9 + 1).cast("int")
    head = F.element_at(F.array(*map(F.lit, ("%PDF-1.7\n", "PK\x03\x04", "PK\x03\x04", "{\\rtf1 ", "<!DOCTYPE html>", "", "", "  <HTML>", ""))), k)
    name = F.element_at(F.array(*map(F.lit, ("a.bin", "b.docx", "c.zip", "d", "e.dat", "F.MD", "g.eml", "h", "i"))), k)
    data = F.concat(head, F.col("text")).cast("binary")
    data = F.when(F.col("doc_id") % 18 == 8, F.concat(F.unhex(F.lit("FF00FE")), data)).otherwise(data)
    return _docs(spark, sf_dir).select("doc_id", detect.mime_type(data, name).alias("mime"))


def source_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = detect.source_stamp(F.col("text").cast("binary"), F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.lit("text/plain"))
    return _docs(spark, sf_dir).select("doc_id", stamp.alias("s")).select("doc_id", "s.*")


QUERIES = {
    f.__name__: f
    for f in (
        canonicalize, canonicalize_idempotent, word_count, est_tokens, token_classes, clean_cell, row_lint, sanitize_scalar, metadata_warnings, path_validate, pdf_dates,
        perm_tokens, plural, url_allowlist, layer_usable, ocr_decision, mime_detect, source_stamp,
    )
}

ORACLE_SQL = {
    "canonicalize": r"""
        with r as (select doc_id, chr(13) || chr(10) || '  ' || replace(text, chr(10), ' ' || chr(9) || chr(13) || chr(10) || chr(13) || chr(10) || chr(13)) || '  ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || lang || ' ' || chr(13) as t from documents),
        a as (select doc_id, regexp_replace(t, '\r\n?', chr(10), 'g') as t from r),
        b as (select doc_id, regexp_replace(t, '[ \t]+\n', chr(10), 'g') as t from a)
        select doc_id, sha256(nfc_normalize(regexp_replace(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', ''))) as sha256 from b""",
    "canonicalize_idempotent": "select count(*)::bigint as n, 0::bigint as changed from documents",
    "word_count": r"select doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::bigint as words, length(text)::bigint as chars from documents",
    "est_tokens": r"""
        with c as (select doc_id, len(regexp_extract_all(text, '\p{Nd}')) as d, len(regexp_extract_all(text, '\p{L}')) as a, len(regexp_extract_all(text, '\s')) as s, length(text) as n,
                          len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) as w from documents)
        select doc_id, ceil(1.07::double * d + 1.07::double * (n - d - a - s) + 0.24::double * a + 0.49::double * w)::bigint as tokens from c""",
    "token_classes": "with " + _TOKENS_SQL + r"""
        select (l_linenumber % 5)::bigint as kind,
               regexp_matches(token, '^[(\-–−+]?(CHF|Fr\.|EUR|€|\$)?\s?[(\-–−]?\d{1,3}([’''`´ ]\d{3})*([.,]\d{1,2})?[)%]?$|^[(\-–−]?\d+([.,]\d{1,2})[)%]?$|^[-–—]{1,2}$')
                 or regexp_matches(token, '^[(\-–−+_.]?\d{1,3}([’''`´:,. ]\d{3})*([.,:]\d{1,2})[.:,°)%]?$') as amount,
               regexp_matches(token, '^(\d{1,2}\.\d{1,2}\.(19|20)?\d{2}|(19|20)\d{2}(/\d{2,4})?)$') as dateyear,
               regexp_matches(token, '^[(\-–−+]?[\d''’.,/%]+[)%]?$') as numlike, regexp_matches(token, '[A-Za-zÄÖÜäöüßÀ-ÿ]{3}') as letters, count(*)::bigint as n
        from t group by all""",
    "clean_cell": r"select doc_id, sha256(trim(regexp_replace(replace(replace(' |' || chr(9) || replace(text, ' ', ' |  ') || chr(10) || ' ', '|', '/'), chr(10), ' '), '[ \t]+', ' ', 'g'))) as sha256 from documents",
    "row_lint": r"""
        select doc_id, sha256(regexp_replace(regexp_replace(trim(regexp_replace(replace(text, chr(10), chr(9) || ' '), '[ \t]+', ' ', 'g')), '([.!?]) ([A-ZÜÖÄ\d"''(])', '\1\2', 'g'), '([.!?]) ([A-ZÜÖÄ\d"''(])', '\1\2', 'g')) as sha256 from documents""",
    "sanitize_scalar": _SANITIZE_SQL,
    "metadata_warnings": f"select category, count(*)::bigint as n from ({_SANITIZE_SQL}) where category is not null group by category",
    "path_validate": "select doc_id, case doc_id % 6 when 1 then 'bidi override' when 2 then 'control character' when 3 then 'too long' end as error from documents",
    "pdf_dates": """
        select o_orderkey, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+02:00' when 1 then strftime(o_orderdate, '%Y-%m-%d')
          when 2 then strftime(o_orderdate, '%Y-%m-%dT%H:%M') || ':00Z' when 3 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' end as iso from orders""",
    "perm_tokens": """
        select o_orderkey, nullif(array_to_string(list_transform(list_filter([[4, 1], [8, 2], [16, 3], [32, 4], [256, 5], [512, 6], [1024, 7], [2048, 8]], lambda p: ((o_orderkey % 4096)::int & p[1]) <> 0),
          lambda p: ['print', 'modify', 'copy', 'annotate', 'form', 'accessibility', 'assemble', 'print_high_res'][p[2]]), ','), '') as rights from orders""",
    "plural": "select conv_id, (count(*) - 2)::varchar || case when count(*) = 3 then ' page' else ' pages' end as told from conversations group by conv_id",
    "url_allowlist": r"""
        select page_id, case page_id % 7 when 1 then false when 2 then false when 6 then false else true end as metadata_ok,
               page_id % 7 in (0, 4, 5) as markdown_ok from pages""",
    "layer_usable": "with " + _LAYERS_SQL + " select doc_id, garbage, usable from u",
    "ocr_decision": "with " + _LAYERS_SQL + """,
        r as (select *, case when cover < 0.3 then 'no_image' when s = '' then 'no_text' when garbage then 'garbage_text' when cover >= 0.85 and length(s) < 200 then 'full_page_scan'
                        when usable then 'usable_text' when length(s) < 20 then 'short_text' else 'sparse_text' end as reason from u)
        select doc_id, reason not in ('no_image', 'usable_text') as needs_ocr, reason not in ('no_text', 'garbage_text') as keep_text_layer, reason,
               case when cover < 0.3 then 'no_image' else 'forced' end as always, 'ocr_disabled' as never from r""",
    "mime_detect": r"""
        with h as (select doc_id, encode(['%PDF-1.7' || chr(10), 'PK' || chr(3) || chr(4), 'PK' || chr(3) || chr(4), '{\rtf1 ', '<!DOCTYPE html>', '', '', '  <HTML>', ''][(doc_id % 9 + 1)::int] || text) as b from documents)
        select doc_id, case when doc_id % 18 = 8 then 'application/octet-stream' when doc_id % 9 in (2, 7, 8) then case when try(decode(array_slice(b, 1, 1024))) is null then 'application/octet-stream' else 'text/plain' end
          else ['application/pdf', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', '', 'application/rtf', 'text/html', 'text/markdown', 'message/rfc822', '', ''][(doc_id % 9 + 1)::int] end as mime from h""",
    "source_stamp": "select doc_id, 'text/plain' as mime_type, sha256(text) as sha256, strlen(text)::bigint as size_bytes, doc_id::varchar || '.txt' as filename, 'in/' || doc_id::varchar || '.txt' as path from documents",
}
