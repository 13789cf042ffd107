"""Inputs that once ended a job, lost a row or shifted offsets."""

import time

import pytest
from pyspark.sql import functions as F

from quirelake.functions import html as H
from quirelake.layout import page, tokens
from quirelake.operators import sections, sentences
from quirelake.schema import Limits
from quirelake.sources.extract import extract, read_files


def test_endless_references(spark):
    rows = [("&#" + "9" * 5000 + ";",), ("&#x" + "f" * 5000 + ";",), ("&#0000000065;&eacute;",), ("&#1114112;&eacute;",)]
    got = [r.t for r in spark.createDataFrame(rows, "t string").select(H.unescape(F.col("t"), True).alias("t")).collect()]
    assert got == ["�", "�", "Aé", "�é"]


def test_front_matter_names_differ_in_case_only(spark):
    text = "---\nFoo: one\nfoo: two\nTITLE: t\n---\nbody"
    got = spark.createDataFrame([(text,)], "t string").select(sections.frontmatter(F.col("t")).alias("f")).select("f.*", sections.promoted(F.col("f.fields")).alias("p")).first()
    assert got.fields == {"foo": "two", "title": "t"} and got.body == "body"
    assert got.p.title == "t" and got.p.extra == {"md:frontmatter.foo": "two"}


def test_files_over_the_cap_are_errors(spark, tmp_path):
    (tmp_path / "big.txt").write_text("x" * 100)
    (tmp_path / "small.txt").write_text("y")
    limits = Limits(max_input_bytes=50)
    got = {r.name: r for r in extract(read_files(spark, str(tmp_path), limits), limits=limits).select(F.regexp_extract("source.path", "[^/]*$", 0).alias("name"), "error").collect()}
    assert got["small.txt"].error is None
    assert (got["big.txt"].error.kind, got["big.txt"].error.what, got["big.txt"].error.limit, got["big.txt"].error.observed) == ("exhausted", "max_input_bytes", 50.0, 100.0)


@pytest.mark.parametrize("text", ["a.￿ b. C d", "One. Two!\n\n Three? 4.", "", " \n", "no end", "A. " * 500, None])
def test_sentence_offsets_hold(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(sentences.sentences(F.col("t")).alias("s")).first().s
    if text is None:
        assert got is None
        return
    for i, s in enumerate(got):
        assert s["index"] == i and text[s.char_start : s.char_end] == s.text and s.line_start == 1 + text[: s.char_start].count("\n")
    assert "".join("".join(s.text.split()) for s in got) == "".join(text.split())


def test_sentences_take_linear_time(spark):
    took = []
    for n in (10_000, 10_000, 20_000):
        df = spark.createDataFrame([("Some words here. " * n,)], "t string").select(F.size(sentences.sentences(F.col("t"))).alias("n"))
        began = time.perf_counter()
        assert df.first().n == n
        took.append(time.perf_counter() - began)
    assert took[2] < 3 * took[1] + 1


def test_seams_use_the_documents_spelling():
    assert tokens.dehyphenate(["Kauf-", "bis Verkauf"]) == "Kauf- bis Verkauf"
    assert tokens.dehyphenate(["Ost-", "schweiz"], frozenset(["ost-schweiz"])) == "Ost-schweiz"
    assert tokens.dehyphenate(["Do\xad", "nau", "", "Dampf-", "schiff-", "fahrt"]) == "Donau Dampfschifffahrt"


def test_packs_repeat_their_head():
    lines = [f"row {i} | {i * 1000}" for i in range(60)]
    packs = page.pack_lines(lines, "name | 2023")
    assert len(packs) > 1 and all(p.startswith("name | 2023\n") for p in packs)
    assert [x for p in packs for x in p.split("\n")[1:]] == lines
    assert all(tokens.est_tokens("name | 2023") + sum(map(tokens.est_tokens, p.split("\n")[1:])) <= page.PACK_TOKENS for p in packs)


BARE = '<html lang="en"><body><h1>x&amp;&amp</h1><p>&eacute; &amp &copy 1 &notit; &#65 &#65; a&b=c</p></body></html>'


def test_references_end_in_a_semicolon_where_bare_ones_do_not_count(spark):
    t = F.col("t")
    got = spark.createDataFrame([(BARE,), ("<p>&amp;&amp</p>",)], "t string").select(H.html_to_text(t, True, bare=False).alias("closed"), H.html_to_text(t, True).alias("all")).collect()
    assert got[0].closed == "x&&amp\n\né &amp &copy 1 &notit; &#65 A a&b=c" and got[1].closed == "&&amp"
    assert got[0].all == "x&&\n\né & © 1 ¬it; A A a&b=c" and got[1].all == "&&"


def _pages_cut_in_a_reference(spark, folder):
    spark.createDataFrame([(1, "https://example.org/", BARE.replace("&notit;", "").replace("&eacute;", "").replace("&#65;", "")), (2, "https://example.org/2", "<title>t</title><p>One&amp. Two.</p>")], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def _as_its_sql(spark, folder, name):
    from quirelake.plans import catalogue
    from tests.duck import rows, views

    assert rows(catalogue.QUERIES[name](spark, folder).toPandas()) == rows(views(folder).sql(catalogue.ORACLE_SQL[name]).df())


def test_html_text_of_pages_cut_in_a_reference(spark, tmp_path):
    _as_its_sql(spark, _pages_cut_in_a_reference(spark, tmp_path), "html_text")


def test_page_citations_of_pages_cut_in_a_reference(spark, tmp_path):
    _as_its_sql(spark, _pages_cut_in_a_reference(spark, tmp_path), "page_citations")


def test_html_extract_of_pages_cut_in_a_reference(spark, tmp_path):
    _as_its_sql(spark, _pages_cut_in_a_reference(spark, tmp_path), "html_extract")
