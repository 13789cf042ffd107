"""Queries of the OCR, layout statistics and metric operators, on word boxes made of orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators import layout, metrics, ocr
from quirelake.schema import Limits


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def image_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as images on their order's page, partly beyond its edge."""
    x, y = F.col("l_quantity") * 12 - 20, F.col("l_linenumber") * 100.0
    boxes = _table(spark, sf_dir, "lineitem").select("l_orderkey", x.alias("bx0"), (y - 60).alias("by0"), (x + F.col("l_discount") * 3000).alias("bx1"), (y + 90).alias("by1"))
    boxes = boxes.withColumns({"px0": F.lit(0.0), "py0": F.lit(0.0), "px1": F.lit(600.0), "py1": F.lit(800.0)})
    return ocr.image_cover(boxes, ["l_orderkey"]).select("l_orderkey", F.round("cover", 6).alias("cover"))


def render_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", ocr.render_dpi((F.col("o_orderkey") % 4000 + 1).cast("double"), (F.col("o_custkey") % 500 + 72).cast("double")).cast("long").alias("dpi"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pages of their order: some need OCR, some are too large, some fail."""
    k = F.col("l_partkey")
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 1_000_000 + k).alias("page"), (k % 3 != 0).alias("needs_ocr"), (k % 7 * 8.0).alias("megapixels"), (k % 5 == 0).alias("failed"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.col("l_returnflag")).alias("text"), (k % 100).cast("double").alias("conf"),
    )


def ocr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ocr.schedule(_pages(spark, sf_dir), "doc", "page", Limits(max_ocr_pages=2)).select("doc", "page", "status")
    return _longs(rows, "page")


def ocr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ocr.summary(ocr.schedule(_pages(spark, sf_dir), "doc", "page", Limits(max_ocr_pages=2)), "doc")
    return _longs(rows, "ocr_pages", "skipped_pages", "failed_pages", "text_pages")


def _tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as engine output: a line row and then its words, one of them blank, and a malformed row."""
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    row = lambda *f: F.concat_ws("\t", *[x if not isinstance(x, str) else F.lit(x) for x in f])
    line = row("4", "1", "1", "1", "1", "0", "0", "0", "500", "14", "-1", "")
    words = F.transform(
        "w",
        lambda x, i: row(
            F.lit("5"), F.lit("1"), (F.floor(i / 6) + 1).cast("string"), F.lit("1"), (F.floor(i / 3) + 1).cast("string"), (i + 1).cast("string"), (i * 40).cast("string"), F.lit("10"), F.lit("36"), F.lit("12"),
            (F.length(x) + 60).cast("string"), F.when(i == 4, F.lit("  ")).otherwise(x),
        ),
    )
    tsv = F.concat_ws("\n", F.lit("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"), line, F.array_join(words, "\n"), F.lit("5\tbroken"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", w.alias("w")).select("conv_id", "turn", tsv.alias("tsv"))


def tsv_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ocr.parse_tsv(_tsv(spark, sf_dir), ["conv_id", "turn"], scale=0.24).drop("at")
    return _longs(words, "block", "par", "line")


def tsv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.words_to_text(ocr.parse_tsv(_tsv(spark, sf_dir), ["conv_id", "turn"]), ["conv_id", "turn"])


_TSV_SQL = r"""
w as (select conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') as w from conversations),
x as (select conv_id, turn, unnest(w) as text, generate_subscripts(w, 1) - 1 as i from w), ws as (select * from x where i <> 4)
"""


def affine_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of pages turned by a quarter, and back again."""
    words = ocr.parse_tsv(_tsv(spark, sf_dir), ["conv_id", "turn"])
    m = (0.0, 2.0, -2.0, 0.0, 1000.0, 5.0)
    turned = ocr.frame_to_page(words, m)
    back = ocr.frame_to_page(turned.withColumnsRenamed({}), ocr.invert(m)).select("conv_id", "turn", "at", *[F.col(c).alias(f"back_{c}") for c in ("x0", "y1")])
    return turned.join(back, ["conv_id", "turn", "at"]).select("conv_id", "turn", "text", "x0", "y0", "x1", "y1", "line_h", "back_x0", "back_y1")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", ocr.cache_key(F.sha2("html", 256), F.col("page_id") % 4 * 90, F.lit(300), "deu", 3, "fake", "p1").alias("key"))


def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir)


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir)
    return ocr.cache_hits(keys, keys.filter("page_id % 3 = 0").select("key").distinct())


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir)
    return ocr.cache_misses(keys, keys.filter("page_id % 3 = 0").select("key"))


def ocr_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page is tried again and which result stands."""
    k = F.col("l_partkey")
    rows = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.struct((k % 50).alias("n_words"), (k % 97).cast("double").alias("conf")).alias("a"), F.struct((k % 53).alias("n_words"), (k % 89).cast("double").alias("conf")).alias("b"),
        ocr.should_retry((k % 97).cast("double"), k % 10 / 100.0, k % 9, k % 4).alias("retry"),
    )
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "retry", ocr.better(F.col("a"), F.col("b"))["n_words"].alias("n_words"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer kept, replaced or appended to, by decision."""
    from quirelake.functions.text import decide_page
    from quirelake.plans.text_queries import _layers

    rows = _layers(spark, sf_dir).withColumn("d", decide_page(F.col("layer"), F.col("cover")))
    return rows.select("doc_id", F.sha2(ocr.page_text(F.col("layer"), F.col("d"), F.lit("read by ocr")), 256).alias("sha256"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page an order, seven orders a document: a line for each line item, of a part's words and an amount; a large first line."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.split("p_name", " ").alias("w"))
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").join(part, "l_partkey")
    amount = F.round("l_extendedprice").cast("long").cast("string")
    y = F.col("l_linenumber") * 20.0 + 40
    tokens = F.concat("w", F.array(amount))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", y.alias("y"), F.posexplode(tokens).alias("k", "text"), F.size("w").alias("n"))
    last = F.col("k") == F.col("n")
    x0 = F.when(last, 500.0 - 5.0 * F.length("text")).otherwise(50.0 + 60.0 * F.col("k"))
    return rows.select(
        F.floor(F.col("l_orderkey") / 7).alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("line"), "text", x0.alias("x0"), (x0 + 5.0 * F.length("text")).alias("x1"),
        (F.col("y") + x0 * 0.01 * (F.col("l_orderkey") % 3)).alias("y0"), (F.col("y") + 10 + x0 * 0.01 * (F.col("l_orderkey") % 3)).alias("y1"),
        F.when(F.col("l_linenumber") == 1, 18.0 - F.col("l_orderkey") % 7).otherwise(10.0).cast("double").alias("size"), (F.col("l_partkey") % 5 == 0).alias("bold"), F.lit(False).alias("rotated"),
    )


_WORDS_SQL = r"""
lw as (select l_orderkey, l_linenumber, l_partkey, l_linenumber * 20.0 + 40 as y, list_append(string_split(p_name, ' '), round(l_extendedprice)::bigint::varchar) as w from lineitem join part on p_partkey = l_partkey),
ex as (select *, unnest(w) as text, generate_subscripts(w, 1) - 1 as k from lw),
xx as (select *, case when k = len(w) - 1 then 500.0 - 5.0 * length(text) else 50.0 + 60.0 * k end::double as x0 from ex),
words as (select l_orderkey // 7 as doc, l_orderkey as page, l_linenumber as line, text, x0, x0 + 5.0 * length(text) as x1, y + x0 * 0.01 * (l_orderkey % 3) as y0, y + 10 + x0 * 0.01 * (l_orderkey % 3) as y1,
  case when l_linenumber = 1 then 18.0 - l_orderkey % 7 else 10.0 end::double as size, l_partkey % 5 = 0 as bold from xx)
"""


def page_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_unit(_words(spark, sf_dir), ["page"]).select("page", F.round("unit", 6).alias("unit"))


def deskew_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.skew(_words(spark, sf_dir), ["page"]).select("page", F.round("slope", 6).alias("slope"))


def body_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.body_stats(_words(spark, sf_dir), "doc").select("doc", "body_em", F.round("body_bold_ratio", 9).alias("body_bold_ratio"))


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(layout.heading_levels(_words(spark, sf_dir), "doc"), "level")


def gutter_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(layout.gutter_runs(_words(spark, sf_dir), ["page"], min_lines=5), "bin", "run")


def furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages with a head line, a numbered foot line, and a line of their own."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    line = lambda text, y: F.struct(text.alias("text"), F.lit(y).alias("y0"), F.lit(y + 10.0).alias("y1"))
    lines = F.array(
        line(F.concat(F.lit("Bericht  "), (F.col("turn") % 2 + 2020).cast("string")), 20.0), line(F.concat(F.lit("Seite "), F.col("turn").cast("string"), F.lit(" von 9")), 780.0),
        line(F.coalesce("text", F.lit("")), 400.0), line(F.concat(F.lit("Kapitel "), F.col("conv_id").cast("string"), F.lit(" "), F.lower(F.substring(F.col("text"), 1, 3))), 770.0),
    )
    rows = c.select("conv_id", "turn", F.explode(lines).alias("l")).select("conv_id", "turn", "l.*", F.lit(800.0).alias("height"))
    return layout.furniture(rows, "conv_id", "turn").groupBy("conv_id", "turn").agg(F.count_if("furniture").alias("furniture"))


def bow_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a turn has more often than the next one."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return metrics.bag_difference(c, c.withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"])


def numeric_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of an order's line items against those of its first three, thousands marked."""
    li = _table(spark, sf_dir, "lineitem").withColumn("n", F.round("l_extendedprice").cast("long"))
    marked = F.concat(F.floor(F.col("n") / 1000).cast("string"), F.lit("'"), F.lpad((F.col("n") % 1000).cast("string"), 3, "0"))
    page = lambda df, item: df.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(item)), " | ").alias("text"))
    found = metrics.numeric_scores(page(li, F.col("n").cast("string")), page(li.filter("l_linenumber <= 3 and n >= 1000"), marked), ["l_orderkey"])
    return found.select("l_orderkey", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").withColumn("place", F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).groupBy("l_orderkey", "place").agg(F.max("l_extendedprice").alias("l_extendedprice"))
    return metrics.kendall_tau(rows, ["l_orderkey"], "place", "l_extendedprice").select("l_orderkey", F.round("tau", 9).alias("tau"))


def _rendered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    amount = F.round("l_extendedprice").cast("long").cast("string")
    rows = li.select("l_orderkey", F.col("p_name").alias("label"), F.array(amount, F.col("l_quantity").cast("long").cast("string")).alias("cells"))
    line = F.concat(F.when(F.col("l_linenumber") % 3 == 0, F.lit("lost")).otherwise(F.upper("p_name")), F.lit(" | 2023: "), amount, F.lit(" | "), F.col("l_quantity").cast("long").cast("string"))
    return rows, li.select("l_orderkey", line.alias("line"))


def row_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.row_integrity(*_rendered(spark, sf_dir), ["l_orderkey"])


def kv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lines = _rendered(spark, sf_dir)
    return metrics.key_values(rows.select("l_orderkey", F.concat("label", F.lit(":")).alias("label"), F.col("cells")[0].alias("value")), lines, ["l_orderkey"])


def character_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(metrics.character_error(F.col("p_name"), F.translate("p_type", "AEIOU", "aeiou")), 9).alias("cer"))


QUERIES = {
    f.__name__: f
    for f in (
        image_cover, render_dpi, ocr_schedule, ocr_summary, tsv_words, tsv_text, affine_boxes, cache_key, cache_hits, cache_misses, ocr_retry, page_text, page_unit, deskew_slope, body_stats,
        heading_levels, gutter_runs, furniture, bow_diff, numeric_prf, kendall_tau, row_integrity, kv_metrics, character_error,
    )
}

_STATUS_SQL = r"""
p as (select l_orderkey as doc, l_linenumber * 1000000 + l_partkey as page, l_partkey as k, l_partkey % 3 <> 0 as needs, (l_partkey % 7) * 8.0 as mp, case when l_partkey % 4 = 0 then '' else l_returnflag end as text from lineitem),
q as (select *, sum(case when needs and mp <= 40 then 1 else 0 end) over (partition by doc order by page rows unbounded preceding) as place from p),
st as (select *, case when not needs then 'not_needed' when mp > 40 then 'oversize' when place > 2 then 'skipped' when k % 5 = 0 then 'failed' else 'done' end as status from q)
"""
_KEY_SQL = "k as (select page_id, sha256(sha256(html) || '|rot=' || (page_id % 4 * 90) || '|dpi=300|lang=deu|psm=3|engine=fake|pre=p1') as key from pages)"
_RENDERED_SQL = r"""
li as (select row_number() over () as k, l_orderkey, l_linenumber, p_name, round(l_extendedprice)::bigint::varchar as a, l_quantity::bigint::varchar as q from lineitem join part on p_partkey = l_partkey),
ln as (select l_orderkey, lower(case when l_linenumber % 3 = 0 then 'lost' else p_name end || ' | 2023: ' || a || ' | ' || q) as line from li),
ok as (select li.l_orderkey, k, bool_or(contains(line, a) and {more} len(list_filter(regexp_extract_all(lower(p_name), '[\p{{L}}\p{{N}}]+'), lambda w: contains(line, w))) >= 0.8 * greatest(1, len(regexp_extract_all(lower(p_name), '[\p{{L}}\p{{N}}]+')))) as ok
       from li join ln on li.l_orderkey = ln.l_orderkey group by 1, 2)
"""

ORACLE_SQL = {
    "image_cover": """
        select l_orderkey, round(least(1.0, sum(greatest(0.0, least(l_quantity * 12 - 20 + l_discount * 3000, 600.0) - greatest(l_quantity * 12 - 20, 0.0))
          * greatest(0.0, least(l_linenumber * 100.0::double + 90, 800.0) - greatest(l_linenumber * 100.0::double - 60, 0.0))) / 480000.0), 6)::double as cover from lineitem group by 1""",
    "render_dpi": "select o_orderkey, greatest(72, round_even(least(300, greatest(72, round_even((o_orderkey % 4000 + 1)::double / ((o_custkey % 500 + 72) / 72.0::double), 0))) / 10.0::double, 0)::bigint * 10)::bigint as dpi from orders",
    "ocr_schedule": "with " + _STATUS_SQL + " select doc, page::bigint as page, status from st",
    "ocr_summary": "with " + _STATUS_SQL + """
        select doc, count(*) filter (status = 'done')::bigint as ocr_pages, count(*) filter (status in ('skipped', 'oversize'))::bigint as skipped_pages, count(*) filter (status = 'failed')::bigint as failed_pages,
               count(*) filter (status = 'not_needed' and text <> '')::bigint as text_pages, round(avg((k % 100)::double) filter (status = 'done'), 2) as mean_conf from st group by doc""",
    "tsv_words": "with " + _TSV_SQL + """
        select conv_id, turn, text, round(i * 40 * 0.24::double, 2) as x0, round(10 * 0.24::double, 2) as y0, round((i * 40 + 36) * 0.24::double, 2) as x1, round(22 * 0.24::double, 2) as y1, (length(text) + 60)::double as conf,
               (i // 6 + 1)::bigint as block, 1::bigint as par, (i // 3 + 1)::bigint as line, round(14 * 0.24::double, 2) as line_h from ws""",
    "tsv_text": "with " + _TSV_SQL + """,
        l as (select conv_id, turn, i // 6 as b, i // 3 as l, string_agg(text, ' ' order by i) as t from ws group by all),
        bl as (select conv_id, turn, b, string_agg(t, chr(10) order by l) as t from l group by all)
        select bl.conv_id, bl.turn, string_agg(t, chr(10) || chr(10) order by b) as text, (select floor(sum(length(w.text) + 60) * 100 / count(*)::double + 0.5) / 100 from ws w where w.conv_id = bl.conv_id and w.turn = bl.turn) as mean_conf from bl group by 1, 2""",
    "affine_boxes": "with " + _TSV_SQL + """
        select conv_id, turn, text, 956.0::double as x0, (i * 80 + 5)::double as y0, 980.0::double as x1, (i * 80 + 77)::double as y1, 28.0::double as line_h, (i * 40)::double as back_x0, 22.0::double as back_y1 from ws""",
    "cache_key": f"with {_KEY_SQL} select * from k",
    "cache_hits": f"with {_KEY_SQL} select * from k where key in (select key from k where page_id % 3 = 0)",
    "cache_misses": f"with {_KEY_SQL} select * from k where key not in (select key from k where page_id % 3 = 0)",
    "ocr_retry": """
        select l_orderkey, l_linenumber::bigint as l_linenumber, (l_partkey % 97 < 70 and l_partkey % 10 >= 2) or (l_partkey % 9 >= 3 and l_partkey % 4 < 0.5 * (l_partkey % 9 - 1)) as retry,
               case when l_partkey % 53 > l_partkey % 50 and l_partkey % 89 >= l_partkey % 97 - 5 then l_partkey % 53 else l_partkey % 50 end as n_words from lineitem""",
    "page_unit": "with " + _WORDS_SQL + " select page, round(coalesce(median(case when length(text) >= 3 then (x1 - x0) / length(text) end), 4.0), 6)::double as unit from words group by page",
    "deskew_slope": "with " + _WORDS_SQL + """,
        l as (select page, line, regr_slope(y1, (x0 + x1) / 2) as s, count(*) as n, max(x1) - min(x0) as w from words group by all),
        m as (select page, median(case when n >= 4 and w >= 100 then s end) as s from l group by page)
        select page, round(case when abs(s) >= 0.0015 then s else 0.0 end, 6)::double as slope from m""",
    "body_stats": "with " + _WORDS_SQL + """,
        z as (select doc, size as em, sum(length(text)) as c, sum(case when bold then length(text) else 0 end) as b from words group by all),
        r as (select *, row_number() over (partition by doc order by c desc, em) as k from z)
        select doc, max(case when k = 1 then em end) as body_em, round(sum(b)::double / sum(c)::double, 9) as body_bold_ratio from r group by doc""",
    "heading_levels": "with " + _WORDS_SQL + """,
        z as (select doc, size as em, sum(length(text)) as c from words group by all), r as (select *, first_value(em) over (partition by doc order by c desc, em) as body from z)
        select doc, em, least(dense_rank() over (partition by doc order by em desc), 3)::bigint as level from r where em >= 1.15::double * body and c >= 3""",
    "gutter_runs": "with " + _WORDS_SQL + """,
        sp as (select page, floor(min(x0) / 2)::bigint as lo, floor(max(x1) / 2)::bigint as hi from words group by page), ls as (select distinct page, line from words),
        ce as (select page, line, unnest(range(lo, hi + 1)) as bin from ls join sp using (page)),
        tk as (select distinct page, line, unnest(range(floor(x0 / 2)::bigint, floor(x1 / 2)::bigint + 1)) as bin from words),
        fr as (select * from ce anti join tk using (page, line, bin)), isl as (select *, line - row_number() over (partition by page, bin order by line) as g from fr), rn as (select page, bin, g, count(*) as run from isl group by all)
        select page, bin::bigint as bin, max(run)::bigint as run from rn group by page, bin having max(run) >= 5""",
    "furniture": r"""
        with l as (select conv_id, turn, 'bericht ' || '#' as m, true as top, false as number from conversations union all select conv_id, turn, 'seite # von #', false, true from conversations
          union all select conv_id, turn, trim(regexp_replace(regexp_replace(lower('Kapitel ' || conv_id || ' ' || left(text, 3)), '\s+', ' ', 'g'), '\d+', '#', 'g')), false, false from conversations),
        n as (select conv_id, count(distinct turn) as n from conversations group by 1), s as (select conv_id, m, top, count(distinct turn) as p, min(turn) as f from l group by all)
        select conv_id, turn, count(*) filter (number or (n >= 2 and p >= greatest(2, ceil(0.4::double * n)) and turn <> f))::bigint as furniture from l join n using (conv_id) join s using (conv_id, m, top) group by all""",
    "bow_diff": r"""
        with t as (select conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as item from conversations),
        d as (select * from t except all select conv_id, turn - 1, item from t) select conv_id, turn, item, count(*)::bigint as n from d group by all""",
    "numeric_prf": """
        with l as (select *, round(l_extendedprice)::bigint as n from lineitem), a as (select l_orderkey, n, count(*) as a from l group by all), b as (select l_orderkey, n, count(*) as b from l where l_linenumber <= 3 and n >= 1000 group by all),
        f as (select l_orderkey, sum(least(coalesce(a, 0), coalesce(b, 0)))::double as hit, greatest(sum(coalesce(b, 0)), 1)::double as nb, greatest(sum(coalesce(a, 0)), 1)::double as na from a full join b using (l_orderkey, n) group by 1)
        select l_orderkey, round(hit / nb, 9) as precision, round(hit / na, 9) as recall, round(case when hit > 0 then 2 * (hit / nb) * (hit / na) / (hit / nb + hit / na) else 0.0 end, 9)::double as f1 from f""",
    "kendall_tau": """
        with l as (select l_orderkey, l_linenumber * 1000000 + l_partkey as k, max(l_extendedprice) as v from lineitem group by all),
        p as (select a.l_orderkey, sum(sign(b.v - a.v)) as s, count(*) filter (a.v <> b.v) as n from l a join l b on a.l_orderkey = b.l_orderkey and a.k < b.k group by 1)
        select l_orderkey, round(coalesce(s, 0)::double / greatest(coalesce(n, 0), 1)::double, 9) as tau from (select distinct l_orderkey from lineitem) left join p using (l_orderkey)""",
    "row_integrity": "with " + _RENDERED_SQL.format(more="contains(line, q) and") + " select l_orderkey, count(*)::bigint as rows_n, count(*) filter (ok)::bigint as rows_ok from ok group by 1",
    "kv_metrics": "with " + _RENDERED_SQL.format(more="") + " select l_orderkey, count(*)::bigint as n, count(*) filter (ok)::bigint as ok from ok group by 1",
    "character_error": "select p_partkey, round(levenshtein(p_name, translate(p_type, 'AEIOU', 'aeiou'))::double / greatest(length(p_name), 1)::double, 9) as cer from part",
}


def _page_text_sql() -> str:
    from quirelake.plans.text_queries import ORACLE_SQL as TEXT_SQL

    decided = TEXT_SQL["ocr_decision"]
    return decided.rpartition("select doc_id, reason not in")[0] + """
        select doc_id, sha256(case when reason in ('no_image', 'usable_text') then s when reason in ('no_text', 'garbage_text') or s = '' then 'read by ocr' else s || chr(10) || chr(10) || 'read by ocr' end) as sha256 from r"""


ORACLE_SQL["page_text"] = _page_text_sql()
