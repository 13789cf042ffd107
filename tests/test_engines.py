"""SQL functions, a fake OCR engine, and image measures."""

import numpy as np
from pyspark.sql import functions as F

from quirelake import sql
from quirelake.operators import engines, images, sentences
from quirelake.schema import Limits


def test_sql_functions(spark):
    sql.register(spark)
    text = "One two. Three\nfour! (Five) x.\n\n Six"
    spark.createDataFrame([(1, text)], "id int, t string").createOrReplaceTempView("texts")
    got = spark.sql("select s.* from texts, lateral extract_sentences(t) s order by index").collect()
    want = spark.table("texts").select(F.explode(sentences.sentences(F.col("t"))).alias("s")).select("s.*").orderBy("index").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    row = spark.sql("select canonicalize_text('a \r\nb'), est_tokens('ab 12'), is_amount('1''200.50'), pdf_date_iso('D:2024')").first()
    assert tuple(row) == ("a\nb", 4, True, "2024")
    assert spark.sql("select rows from html_tables('<table><tr><th>a<tr><td>1</table>')").first().rows == [["1"]]
    assert spark.sql("select heading, level from extract_sections('# A\nx\n## B')").count() == 2


TSV = "4\t1\t1\t1\t1\t0\t0\t0\t50\t10\t-1\t\n5\t1\t1\t1\t1\t1\t0\t0\t20\t10\t90\tread\n5\t1\t1\t1\t2\t1\t0\t20\t20\t10\t80\ttoo"


def fake(image, options):
    if image == b"bad":
        raise RuntimeError("no")
    assert options["language"] == "deu+eng"
    return TSV


def _pages(spark):
    rows = [(1, 0, "", 1.0, b"img", 2.0), (1, 1, "", 1.0, b"bad", 2.0), (1, 2, "A layer that is long enough to be used here", 0.5, b"x", 2.0), (1, 3, "", 1.0, b"big", 90.0), (1, 4, "", 1.0, b"late", 2.0), (2, 0, "stamp 12", 0.9, b"img", 2.0)]
    return spark.createDataFrame([(d, p, t, c, bytearray(i), m) for d, p, t, c, i, m in rows], "doc int, page int, layer string, cover double, image binary, megapixels double")


def test_document_ocr(spark):
    got = {(r.doc, r.page): r for r in engines.run_document_ocr(_pages(spark), "doc", "page", fake, limits=Limits(max_ocr_pages=2)).collect()}
    assert {k: r.status for k, r in got.items()} == {(1, 0): "done", (1, 1): "failed", (1, 2): "not_needed", (1, 3): "oversize", (1, 4): "skipped", (2, 0): "done"}
    assert got[1, 0].text == "read\ntoo" and got[1, 0].conf == 85.0
    assert got[1, 2].text.startswith("A layer") and got[2, 0].text == "stamp 12\n\nread\ntoo"


def test_cache_and_budget(spark):
    pages = _pages(spark)
    cache = engines.run_document_ocr(pages, "doc", "page", fake).filter("tsv is not null").select("key", "tsv")
    cached = spark.createDataFrame(cache.collect(), cache.schema)

    def never(image, options):
        raise AssertionError

    got = {(r.doc, r.page): r.status for r in engines.run_document_ocr(pages, "doc", "page", never, cached).collect()}
    assert got[1, 0] == "done" and got[1, 1] == "failed"
    late = engines.run_document_ocr(pages, "doc", "page", fake, limits=Limits(ocr_time_budget_seconds=-1.0)).filter("needs_ocr and megapixels < 40")
    assert {r.status for r in late.collect()} == {"skipped"}


def test_time_budget_is_of_a_document(spark):
    """Each look at the clock takes a second; thirty short documents and one slow one in few tasks."""

    class Clock:
        now = 0

        def __call__(self):
            self.now += 1
            return self.now

    rows = [(d, p, bytearray(b"img"), "done") for d in range(30) for p in range(3)] + [(99, p, bytearray(b"img"), "done") for p in range(20)]
    pages = spark.createDataFrame(rows, "doc int, page int, image binary, status string").coalesce(1)
    got = engines.recognize(pages, ["doc", "page"], fake, {"language": "deu+eng"}, Limits(ocr_time_budget_seconds=10.0), Clock()).collect()
    assert len(got) == len(rows)
    assert {r.status for r in got if r.doc != 99} == {"done"}
    assert [r.status for r in sorted(got) if r.doc == 99] == ["done"] * 10 + ["skipped"] * 10
    assert all((r.tsv is not None) == (r.status == "done") for r in got)


def test_image_measures():
    page = np.full((200, 300), 230, np.uint8)
    for y in range(20, 180, 20):
        page[y : y + 8, 30:270] = 40
    dark = images.ink(page)
    assert 40 <= images.otsu(page) < 230 and abs(images.ink_fraction(page) - dark.mean()) < 1e-9
    assert images.skew_degrees(dark) == 0.0 and images.sideways_ratio(dark) < 1 < images.sideways_ratio(dark.T)
    turned = np.zeros((240, 300), bool)
    y, x = np.nonzero(dark)
    turned[np.clip(np.round(y + 20 + (x - 150) * np.tan(np.radians(1.5))).astype(int), 0, 239), x] = True
    assert abs(images.skew_degrees(turned) - 1.5) <= 0.2
    lined = np.zeros((50, 80), bool)
    lined[10:12, 5:70] = lined[5:45, 40] = True
    assert images.rules(lined, 30) == [{"kind": "h", "x0": 5.0, "y0": 10.0, "x1": 70.0, "y1": 12.0}, {"kind": "v", "x0": 40.0, "y0": 5.0, "x1": 41.0, "y1": 45.0}]
    assert images.is_rule_word((39.5, 10, 41, 30), images.rules(lined, 30), 0.6) and not images.is_rule_word((0, 0, 20, 10), images.rules(lined, 30))
