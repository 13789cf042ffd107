"""Documents of very many headings and sentences: whole results, held against a plain pass over the lines."""

import hashlib
import re

import duckdb
import pandas as pd
import pytest

from quirelake.operators import sections, sentences
from quirelake.plans import catalogue
from tests.duck import rows, views


def texts(con):
    """Markdown by region, as the queries compose it."""
    docs = {}
    customers = con.execute("select c_nationkey, string_agg('### ' || c_name || chr(10) || chr(10) || 'in ' || c_mktsegment, chr(10) || chr(10) order by c_custkey) from customer group by 1").fetchall()
    bodies = dict(customers)
    for region, name in con.execute("select r_regionkey, r_name from region").fetchall():
        nations = con.execute("select n_nationkey, n_name from nation where n_regionkey = ? order by 1", [region]).fetchall()
        if nations:
            docs[region] = f"# {name}\n\n" + "\n\n".join(f"## {n}\n\n{bodies.get(k, 'none')}" for k, n in nations)
    return docs


def plain_sections(text):
    """[index, heading, level, text, first line, last line] by a stack."""
    lines, found, stack = text.split("\n"), [], []
    for at, line in enumerate(lines):
        if line.startswith("#"):
            level = len(line) - len(line.lstrip("#"))
            while stack and found[stack[-1]][2] >= level:
                found[stack.pop()][5] = at
            stack.append(len(found))
            found.append([len(found), line.lstrip("# "), level, None, at + 1, len(lines)])
    for s in found:
        s[3] = "\n".join(lines[s[4] : s[5]]).strip()
    return found


def plain_sentences(text):
    """(index, start, end, line, text) of sentences."""
    found, at = [], 0
    for k, piece in enumerate(re.split("\x01", re.sub(r"([.!?]\s+)(?=[A-ZÜÖÄ\d\"'(])", "\\1\x01", text))):
        body = piece.rstrip(" \n\t")
        found.append((k, at, at + len(body), body))
        at += len(piece)
    out, line, last = [], 1, 0
    for k, start, end, body in found:
        line += text.count("\n", last, start)
        last = start
        out.append((k, start, end, line, body))
    return out


def plain(con, name):
    """The rows of a query."""
    out = []
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for region, text in texts(con).items():
        if name == "md_sections":
            out += [dict(r_regionkey=region, index=i, heading=h, level=lv, text_sha256=sha(t), line_start=a, line_end=b) for i, h, lv, t, a, b in plain_sections(text)]
            continue
        text = text.replace("\n\nin ", ".\n\nMarket: ")
        heads = [(k + 1, line.lstrip("# ")) for k, line in enumerate(text.split("\n")) if line.startswith("#")]
        told, k = [], -1
        for i, start, end, line, body in plain_sentences(text):
            while k + 1 < len(heads) and heads[k + 1][0] <= line:
                k += 1
            told.append((i, start, end, line, body, k, heads[k][1]))
        if name == "sentence_section":
            out += [dict(r_regionkey=region, index=i, line_start=line, section_index=k) for i, _, _, line, _, k, _ in told]
        elif name == "citations":
            digest = sha(text)
            out += [dict(sha256=digest, path=f"in/{region}.md", index=i, char_start=a, char_end=b, heading=h, text=t) for i, a, b, _, t, _, h in told]
        else:
            for c in range(0, len(told), 5):
                p = told[c : c + 5]
                lines = [x[3] for x in p], [x[3] + x[4].count("\n") for x in p]
                out.append(dict(r_regionkey=region, chunk=c // 5, text_sha256=sha(" ".join(x[4] for x in p)), char_start=p[0][1], char_end=p[-1][2], line_start=min(lines[0]), line_end=max(lines[1]), headings="|".join(sorted({x[6] for x in p}))))
    return pd.DataFrame(out)


NAMES = ["md_sections", "sentence_section", "citations", "chunk_cite"]


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """A region with 104 000 customers, more than a document's sentences are capped at elsewhere, and one with a nation without any."""
    folder = str(tmp_path_factory.mktemp("large"))
    con = duckdb.connect()
    con.sql(f"copy (select i as r_regionkey, 'R' || i as r_name from range(3) t(i)) to '{folder}/region.parquet'")
    con.sql(f"copy (select i::int as n_nationkey, 'N' || i as n_name, (i // 3)::int as n_regionkey from range(4) t(i)) to '{folder}/nation.parquet'")
    con.sql(f"copy (select i as c_custkey, 'C' || i as c_name, (i % 3)::int as c_nationkey, 'M' || i % 5 as c_mktsegment from range(104000) t(i)) to '{folder}/customer.parquet'")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_plain_form_is_the_sql(sf, name):
    assert rows(plain(views(sf), name)) == rows(views(sf).sql(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", NAMES)
def test_a_document_of_very_many_sections(spark, large, name):
    assert rows(catalogue.QUERIES[name](spark, large).toPandas()) == rows(plain(views(large), name))


def test_sections_that_overlap_or_leave_gaps(spark):
    spans = [(0, 1, 10), (1, 3, 20), (2, 5, 6), (3, 5, 6), (4, 30, 30), (5, 8, 7)]
    asked = [(k, line) for k, line in enumerate([0, 1, 2, 3, 5, 6, 7, 9, 10, 11, 20, 21, 30, 31])]
    found = spark.createDataFrame([(d, *x) for d in ("a", None) for x in asked], "d string, index int, line_start int")
    spanned = spark.createDataFrame([(d, *x) for d in ("a", "b", None) for x in spans], "d string, index int, line_start int, line_end int")
    got = {(r.d, r["index"]): r.section_index for r in sentences.with_sections(found, spanned, "d").collect()}
    want = {("a", k): min(((b - a, i) for i, a, b in spans if a <= line <= b), default=(0, None))[1] for k, line in asked}
    assert got == want | {(None, k): None for k, _ in asked}


def test_sections_of_any_level_and_of_no_document(spark):
    docs = spark.createDataFrame([("a", "x\n# A\na\n\n### B\nb\n## C\n\n c\n# D"), ("b", "no heading"), (None, "# N\nn"), ("d", None)], "d string, text string")
    tree = {(r.d, r["index"]): (r.heading, r.level, r.text, r.line_start, r.line_end) for r in sections.markdown_sections(docs, "d").collect()}
    assert tree == {("a", 0): ("A", 1, "a\n\n### B\nb\n## C\n\n c", 2, 9), ("a", 1): ("B", 3, "b", 5, 6), ("a", 2): ("C", 2, "c", 7, 9), ("a", 3): ("D", 1, "", 10, 10), (None, 0): ("N", 1, "n", 1, 2)}
    flat = sections.markdown_sections(docs.filter("d = 'a'"), "d", any_level=True).orderBy("index").collect()
    assert [(r.heading, r.line_start, r.line_end, r.text) for r in flat] == [("A", 2, 4, "a"), ("B", 5, 6, "b"), ("C", 7, 9, "c"), ("D", 10, 10, "")]


def text_shuffles(frame):
    """How many exchanges have a column named text."""

    def walk(node):
        names = [node.output().apply(k).name() for k in range(node.output().size())]
        below = node.children()
        return (node.nodeName() == "Exchange" and "text" in names) + sum(walk(below.apply(k)) for k in range(below.size()))

    return walk(frame._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize(("name", "most"), [("sentence_section", 0), ("citations", 1), ("chunk_cite", 0)])
def test_texts_are_shuffled_once(spark, sf, name, most):
    """Sentences meet their heading, or their chunk (as the buffers of its sum), in one shuffle of their texts."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert text_shuffles(catalogue.QUERIES[name](spark, sf)) <= most
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_headings_of_sentences_in_equal_sections_and_in_none(spark):
    spans = spark.createDataFrame([("a", 0, 2, 9, "A"), ("a", 1, 4, 5, None), ("a", 1, 4, 5, "twin"), ("b", 0, 1, 1, "B")], "d string, index int, line_start int, line_end int, heading string")
    lines = [("a", 0, 1), ("a", 1, 2), ("a", 2, 4), ("a", 3, 9), ("a", 4, 10), ("a", 5, 11), ("b", 0, 1), ("c", 0, 1), (None, 0, 1)]
    found = spark.createDataFrame([(d, i, f"s{i}", i, i + 1, n, n) for d, i, n in lines], "d string, index int, text string, char_start int, char_end int, line_start int, line_end int")
    told = {(r.d, r["index"]): (r.section_index, r.heading) for r in sentences.citations(found, spans, "d").collect()}
    assert told.pop(("a", 2)) in ((1, None), (1, "twin"))
    assert told == {("a", 0): (None, None), ("a", 1): (0, "A"), ("a", 3): (0, "A"), ("a", 4): (None, None), ("a", 5): (None, None), ("b", 0): (0, "B"), ("c", 0): (None, None), (None, 0): (None, None)}
    one = spans.filter("heading is not null")
    chunks = {(r.d, r.chunk): (r.text, r.char_start, r.char_end, r.line_start, r.line_end, r.headings) for r in sentences.chunks(found, "d", 4, sentences.section_links(found, one, "d", ["heading"])).collect()}
    assert chunks == {
        ("a", 0): ("s0 s1 s2 s3", 0, 4, 1, 9, ["A", "twin"]), ("a", 1): ("s4 s5", 4, 6, 10, 11, []), ("b", 0): ("s0", 0, 1, 1, 1, ["B"]), ("c", 0): ("s0", 0, 1, 1, 1, []), (None, 0): ("s0", 0, 1, 1, 1, []),
    }
