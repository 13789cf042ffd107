"""Readers, renderer and extraction on small inputs."""

import json
import struct
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.layout import page as P
from quirelake.layout import tokens as K
from quirelake.plans import fixtures
from quirelake.schema import Limits
from quirelake.sources import extract as E
from quirelake.sources import html_dom, mail, msg, office, pdf
from quirelake.sources.record import Refusal, canonical


@given(st.text(alphabet=" \t\r\nab  \x0b", max_size=40))
def test_canonical_is_idempotent(text):
    once = canonical(text)
    assert canonical(once) == once
    assert "\n\n\n" not in once and once == once.strip()


def test_canonical_column_agrees(spark):
    from quirelake.functions.text import canonicalize

    texts = ["", " a \r\nb \n\n\n\nc ", "é", " x\x0b\ny\x85z", "a\rb\r\n\r\rc\t"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", canonicalize(F.col("t"), nfc=True).alias("c")).collect()
    assert [r.c for r in rows] == [canonical(r.t) for r in rows]


HOSTILE = [
    "<p>a<script>alert(1)</script >b", "<a href='javascript:alert(1)'>x</a>", "<a href=' JaVaScRiPt:alert(1)'>x</a>", "<img src=x onerror=alert(1) alt='A'>", "<svg><script>1</script></svg>t", "<iframe src='http://x'></iframe>y",
    "<!-- <b> --><p>z", "<![CDATA[<script>]]>q", "<a href='//host/x'>rel</a>", "<p style='x' ONCLICK='y'>w", "<math><mi>1</mi></math>v", "<base href='javascript:'>u", "<object data='x'>o</object>", "<template><b>t</b></template>s",
]


@pytest.mark.parametrize("html", HOSTILE)
def test_markdown_is_safe(html):
    md = html_dom.read_html(html).markdown.lower()
    assert not any(x in md for x in ("javascript:", "<script", "onerror", "onclick", "<iframe", "<svg", "alert(1)<", "//host"))
    assert html_dom.scrub_links(md) == md


def test_deep_html_is_refused_in_its_row(spark):
    rows = [("a.html", bytearray(b"<div>" * 400 + b"x")), ("b.html", bytearray(b"<p>ok"))]
    got = {r.source.path: r for r in E.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.html"].error.kind == "exhausted" and got["a.html"].error.what == "max_recursion_depth"
    assert got["b.html"].error is None and got["b.html"].content.text == "ok"


def test_link_scrub_balances_parentheses():
    counts = Counter()
    md = "[a](javascript:alert(1)) ![i](x) [b](https://x/(y)) [c](/rel) [d](http://z"
    assert html_dom.scrub_links(md, counts) == "a i [b](https://x/(y)) c [d](http://z"
    assert counts == {"url javascript": 1, "images": 1, "url relative": 1}


def test_html_tables_and_sections():
    out = html_dom.read_html("<h1>A</h1><p>x<h2>B</h2><p>y<h1>C</h1>z<table><thead><tr><th>k<th>v</thead><tr><td>1<td>2<tr><td>k<td>v<tr><td>3</table><table><tr><td>only</table>")
    assert [(s["heading"], s["level"], s["text"]) for s in out.sections][:2] == [("A", 1, "x\nB\ny"), ("B", 2, "y")]
    assert [(t["client_table_hint"], t["headers"], t["rows"]) for t in out.tables] == [("html_dom_t0", ["k", "v"], [["1", "2"], ["k", "v"], ["3", ""]])] or out.tables[0]["headers"] == ["k", "v"]


def test_mail_prefers_plain_and_counts_attachments():
    raw = (
        b"Subject: =?utf-8?b?w6k=?=\r\nFrom: a@b\r\nDate: nonsense\r\nContent-Type: multipart/mixed; boundary=x\r\n\r\n--x\r\nContent-Type: text/html\r\n\r\n<p>h\r\n--x\r\nContent-Type: text/plain; charset=latin-1\r\n\r\np\xe9\r\n"
        b"--x\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename=n.txt\r\n\r\nno\r\n--x--\r\n"
    )
    out = mail.read_mail(raw)
    assert (out.text, out.title, out.created, out.extra["eml:attachments"]) == ("pé", "é", None, "n.txt")
    assert mail.read_mail(b"Content-Type: text/html\r\n\r\n<p>only</p><script>x</script>").text == "only"
    assert mail.read_mail(b"").text == ""


def test_zip_guards():
    import io
    import zipfile

    with pytest.raises(Refusal, match="corrupt"):
        office.open_zip(b"PK\x03\x04junk")
    for name, size, kind in (("../x", 1, "corrupt"), ("a", 8 << 20, "exhausted")):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, b"\0" * size)
        with pytest.raises(Refusal, match=kind):
            office.open_zip(buffer.getvalue())
    with pytest.raises(Refusal, match="document type"):
        office._xml(b"<!DOCTYPE x [<!ENTITY a 'b'>]><x>&a;</x>")


def test_docx_layout_mode():
    out = office.read_docx(fixtures.docx(["Title", "para"], [["k", "v"], ["a", "1"], ["b", "2"]], "T"), layout=True)
    assert out.text == "Title\n\npara\n\nk | v\na | 1\nb | 2"
    assert out.sections[0]["text"] == "para\n\nk | v\na | 1\nb | 2"


def test_rtf():
    out = office.read_rtf(rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 A;}}{\*\gen x}a\'e9" + b"\\u" + rb"8364?\par b\{c\}{\object o}\emdash d}")
    assert out.text == "aé€\nb{c}—d" and "rtf: embedded objects present" in out.warnings
    with pytest.raises(Refusal):
        office.read_rtf(b"no")


def test_pdf_encrypted_and_broken():
    good = fixtures.pdf([["one", "two"], [], ["three (x) \\"]], "t")
    out = pdf.read_pdf(good)
    assert (out.text, out.page_count, out.created) == ("one\ntwo\n\nthree (x) \\", 3, "2024-03-05T10:00:00Z")
    assert [(p["line_start"], p["line_end"]) for p in out.pages] == [(1, 2), (None, None), (4, 4)]
    with pytest.raises(Refusal, match="encrypted"):
        pdf.read_pdf(good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt << >>"))
    with pytest.raises(Refusal, match="max_pages"):
        pdf.read_pdf(good, max_pages=2)
    with pytest.raises(Refusal, match="corrupt"):
        pdf.read_pdf(b"junk")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.sampled_from(["application/pdf", "text/html", "message/rfc822", "application/rtf", "application/vnd.ms-outlook", E.detect.DOCX, "text/plain", "image/png"]))
def test_no_bytes_raise(data, mime):
    heads = {"application/pdf": b"%PDF-1.4\n1 0 obj\n<<", "application/rtf": b"{\\rtf1 ", "application/vnd.ms-outlook": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"}
    for d in (data, heads.get(mime, b"") + data):
        row = E.parse_one(d, mime, Limits(), True, "plain", {})
        assert row["error"] is None or row["error"]["kind"] in ("unsupported", "corrupt", "encrypted", "exhausted")


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file whose streams are all in the root's mini stream."""
    entries, mini, mini_fat = [], b"", []
    for i, (name, body) in enumerate(streams.items()):
        n = max(1, -(-len(body) // 64))
        start = len(mini) // 64
        mini_fat += [start + k + 1 for k in range(n - 1)] + [0xFFFFFFFE]
        mini += body.ljust(64 * n, b"\0")
        entries.append((name, 2, i + 2 if i + 1 < len(streams) else 0xFFFFFFFF, 0xFFFFFFFF, start, len(body)))
    mini = mini.ljust(-(-len(mini) // 512) * 512, b"\0")
    directory = b""
    for name, kind, right, child, start, size in [("Root Entry", 5, 0xFFFFFFFF, 1, 3, len(mini)), *entries]:
        raw = name.encode("utf-16-le") + b"\0\0"
        directory += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, 0xFFFFFFFF, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)
    directory = directory.ljust(-(-len(directory) // 512) * 512, b"\0")
    n_mini, n_dir = len(mini) // 512, len(directory) // 512
    # sectors: 0 FAT, 1 mini FAT, 2 unused, 3.. mini stream, then the directory
    fat = [0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE, *[3 + k + 1 for k in range(n_mini - 1)], 0xFFFFFFFE, *[3 + n_mini + k + 1 for k in range(n_dir - 1)], 0xFFFFFFFE]
    pack = lambda xs: struct.pack(f"<{len(xs)}I", *xs).ljust(512, b"\xff")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, 3 + n_mini, 0, 4096, 1, 1, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108) + pack(fat) + pack(mini_fat) + b"\0" * 512 + mini + directory


def test_msg():
    w = lambda s: s.encode("utf-16-le")
    out = msg.read_msg(compound({"__substg1.0_0037001F": w("Subject é"), "__substg1.0_1000001F": w("Body line\r\ntwo " + "x" * 100), "__substg1.0_0C1A001F": w("Sender")}))
    assert (out.title, out.author) == ("Subject é", "Sender") and out.text.startswith("Body line\ntwo xxx")
    with pytest.raises(Refusal):
        msg.read_msg(b"junk")


def test_extract_row_shape(spark):
    rows = [
        ("a/x.md", bytearray(b"---\ntitle: T\nk: v\n---\n# H\nOne. Two.\n\n## S\nThree.")), ("b‮.txt", bytearray(b"x")), ("c.txt", None), ("d.txt", bytearray(b"\xff\xfeh\0i\0")), ("e.pdf", bytearray(fixtures.pdf([["One. Two."], ["Three."]], "t"))),
    ]
    out = E.extract(spark.createDataFrame(rows, "path string, content binary"), emit_sentences=True)
    got = {r.source.path: r for r in out.collect()}
    md = got["a/x.md"]
    assert (md.metadata.title, md.metadata.extra["md:frontmatter.k"], md.content.text) == ("T", "v", "# H\nOne. Two.\n\n## S\nThree.")
    assert [s.text for s in md.content.sentences] == ["# H\nOne.", "Two.\n\n## S\nThree."] or all(md.content.text[s.char_start : s.char_end] == s.text for s in md.content.sentences)
    assert got["b‮.txt"].error.kind == "value" and got["c.txt"].content.text == "" and got["d.txt"].content.text == "hi"
    assert [(s.page_number, s.text) for s in got["e.pdf"].content.sentences] == [(1, "One."), (1, "Two."), (2, "Three.")]
    back = E.from_json(E.to_json(out))
    assert sorted(map(str, back.collect())) == sorted(map(str, out.select(back.columns).collect()))


def test_added_reader(spark):
    from quirelake.sources.record import Parsed

    E.register_reader("application/x-caps", lambda data, limits: Parsed(text=data.decode().upper()))
    df = spark.createDataFrame([("a.caps", bytearray(b"abc"), "application/x-caps")], "path string, content binary, mime string")
    assert E.extract(df, mime="mime").first().content.text == "ABC"


def test_stream_and_files(spark, tmp_path):
    from quirelake.streaming.files import extract_stream, file_stream

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one")
    (src / "b.txt").write_text("one")
    (src / "c.html").write_text("<p>two")
    for _ in range(2):
        q = extract_stream(file_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
        q.awaitTermination()
        (src / "d.txt").write_text("two")
    got = sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).select("content.text").collect())
    assert got == ["one", "two", "two"]
    assert E.read_files(spark, str(src), Limits(max_input_bytes=3)).filter("content is null").count() == 1


def test_command_line(spark, tmp_path, capsys):
    from quirelake import cli

    (tmp_path / "a.md").write_text("# T\ntext")
    assert cli.main([str(tmp_path / "*.md"), "--emit-sentences"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["content"]["text"] == "# T\ntext"
    (tmp_path / "b.pdf").write_text("junk")
    assert cli.main([str(tmp_path)]) == 1
    assert cli.main(["--no-such"]) == 2


def boxes(rows, size=10.0):
    """Words of rows of (x, text[, right-aligned]) cells, 16 points apart."""
    out = []
    for i, row in enumerate(rows):
        for x, text, *right in row:
            x0 = x - 5.0 * len(text) if right else float(x)
            for w in text.split(" "):
                out.append(P.Word(x0, 100 + 16.0 * i, x0 + 5 * len(w), 110 + 16.0 * i, w, size))
                x0 += 5 * (len(w) + 1)
    return out


def test_table_with_years():
    rows = [[(50, "Position"), (400, "2023", 1), (500, "2022", 1)], [(50, "Cash and bank"), (400, "1'200.00", 1), (500, "900.50", 1)], [(50, "Debtors"), (400, "300.00", 1)], [(50, "Total assets"), (400, "1'500.00", 1), (500, "900.50", 1)]]
    got = P.render_page(boxes(rows), "plain", P.DocumentStats())
    assert got.structured and got.text == "Position | 2023 | 2022\nCash and bank | 2023: 1'200.00 | 2022: 900.50\nDebtors | 2023: 300.00\nTotal assets | 2023: 1'500.00 | 2022: 900.50"
    assert got.tables[0]["rows"][1] == ["Debtors", "300.00", ""]


def test_prose_is_passed_through():
    rows = [[(50, "Some words that make a line of prose")], [(50, "and another line that follows it")], [(50, "and a third one")]]
    assert P.render_page(boxes(rows), "byte\n for byte ", P.DocumentStats()) == P.Rendered("byte\n for byte ", False)


def test_form_lines():
    rows = [[(50, "Name: Meier Hans")], [(50, "Ort: Basel")], [(50, "Betrag: 12.50")]]
    assert P.render_page(boxes(rows), "", P.DocumentStats()).text == "Name: Meier Hans\nOrt: Basel\nBetrag: 12.50"


def test_boxes_below_labels():
    rows = [[(50, "Kunden-Nr."), (200, "Datum"), (400, "Betrag CHF")], [(50, "10482"), (200, "12.03.2024"), (400, "1'200.00")], [], [(50, "Some closing words of the letter")]]
    got = P.render_page(boxes(rows), "", P.DocumentStats())
    assert got.text == "Kunden-Nr.: 10482\nDatum: 12.03.2024\nBetrag CHF: 1'200.00\n\nSome closing words of the letter"


def test_columns_of_prose_beside_a_table():
    prose = [[(50, f"left words of line {i}"), (320, f"right words of line {i}")] for i in "abcdef"]
    table = [[], [(50, "Item"), (400, "2023", 1)], [(50, "One"), (400, "10.00", 1)], [(50, "Two"), (400, "20.00", 1)], [(50, "Three"), (400, "30.00", 1)]]
    lines = P.render_page(boxes(prose + table), "", P.DocumentStats()).text.split("\n")
    assert lines[0] == " ".join(f"left words of line {i}" for i in "abcdef") and lines[2] == " ".join(f"right words of line {i}" for i in "abcdef")
    assert lines[-1] == "Three | 2023: 30.00"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.text(alphabet="abc19.'", min_size=1, max_size=6)), min_size=1, max_size=4), min_size=1, max_size=12))
def test_rendering_keeps_words_and_rules(rows):
    words = boxes([sorted({x * 60: (x * 60, t) for x, t in row}.values()) for row in rows])
    plain = " ".join(w.text for w in words)
    got = P.render_page(words, plain, P.DocumentStats())
    assert P.render_page(list(reversed(words)), plain, P.DocumentStats()) == got
    assert not K.broken_rules(got.text, None if got.structured else len(plain))
    if got.structured:
        have = Counter("".join(c for c in got.text if c.isalnum()))
        assert not Counter("".join(c for w in words if not K.LEADER.match(w.text) for c in w.text if c.isalnum())) - have


def test_long_rows_are_split():
    cells = [" ".join(["wort"] * 300), "12.50", "x" * 3000]
    lines = K.split_row("Label", cells)
    assert len(lines) > 2 and all(x.startswith("Label") for x in lines) and all("(Forts.)" in x for x in lines[1:])
    assert sum(x.count("wort") for x in lines) == 300 and sum(x.count("12.50") for x in lines) == 1
    assert K.split_row("", []) == [] and K.split_row("a", ["b"]) == ["a | b"]


def test_dehyphenation():
    assert K.dehyphenate(["Steuerer-", "klärungen"]) == "Steuererklärungen"
    assert K.dehyphenate(["Lieferungs-", "und Leistung"]) == "Lieferungs- und Leistung"
    assert K.dehyphenate(["Ost-", "Schweiz"]) == "Ost-Schweiz"
    assert K.dehyphenate(["Ost-", "Schweiz"], frozenset(["ostschweiz"])) == "Ostschweiz"


def test_objects_of_a_pdf_are_read_once(monkeypatch):
    from quirelake.plans.fixtures import pdf as make
    from quirelake.sources import pdf

    places, plain = [], pdf.Document._value
    monkeypatch.setattr(pdf.Document, "_value", lambda self, at: (places.append(at), plain(self, at))[1])
    out = pdf.read_pdf(make([[f"(page {k}) \\ (a(b)", "x"] for k in range(50)], "t"))
    assert out.page_count == 50 and out.text.startswith("(page 0) \\ (a(b)\nx\n\n(page 1)") and out.title == "t"
    assert len(places) == len(set(places)) == 3 + 2 * 50 + 1 + 1


def test_parsing_leaves_key_columns_in_arrow(spark):
    files = spark.createDataFrame([("a/b.txt", bytearray(b"x  \ny"))], "path string, content binary")
    out = E.extract(files)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    r = out.first()
    assert r.content.text == "x\ny" and r.source.filename == "b.txt" and r.metadata.extra == {"txt:charset": "utf-8"} and r.error is None
