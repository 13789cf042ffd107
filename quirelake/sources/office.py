"""DOCX by zip and expat, and RTF."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from quirelake.sources.record import Parsed, Refusal, canonical, capped_table, scrub, sections_of

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Parts and fields of document properties.
CORE = "title creator language created modified subject keywords description category lastModifiedBy revision contentStatus".split()
APP = "Application AppVersion Company Manager Pages Words Characters Lines Paragraphs Template".split()


def _xml(raw: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise Refusal("corrupt", "document type in XML")
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError as e:
        raise Refusal("corrupt", "XML") from e


def open_zip(data: bytes, max_ratio: float = 100.0, max_entry: int = 256 << 20) -> zipfile.ZipFile:
    """The archive, unless an entry's name leaves it or an entry declares too much."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Refusal("corrupt", "zip") from e
    for i in z.infolist():
        if i.flag_bits & 1:
            raise Refusal("encrypted", "zip entry")
        if i.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", i.filename):
            raise Refusal("corrupt", "zip entry name")
        if i.file_size > max_entry:
            raise Refusal("exhausted", "zip entry size", max_entry, i.file_size)
        if i.compress_size and i.file_size / i.compress_size > max_ratio and i.file_size > 1 << 16:
            raise Refusal("exhausted", "max_decompression_ratio", max_ratio, i.file_size / i.compress_size)
    return z


def _paragraph(p: ElementTree.Element) -> str:
    out = []
    for n in p.iter():
        if n.tag == f"{_W}t":
            out.append(n.text or "")
        elif n.tag == f"{_W}tab":
            out.append("\t")
        elif n.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def _grid(table: ElementTree.Element) -> list[list[str]]:
    """Rows by grid column: skipped columns are empty, spans take their width, vertical merges repeat a short text."""
    rows: list[list[str]] = []
    for tr in table.findall(f"{_W}tr"):
        before = tr.find(f"{_W}trPr/{_W}gridBefore")
        row = [""] * min(63, int(before.get(f"{_W}val", "0")) if before is not None else 0)
        for tc in tr.findall(f"{_W}tc"):
            text = " ".join(filter(None, (_paragraph(p).strip() for p in tc.findall(f"{_W}p"))))
            merge, span = tc.find(f"{_W}tcPr/{_W}vMerge"), tc.find(f"{_W}tcPr/{_W}gridSpan")
            if merge is not None and merge.get(f"{_W}val") != "restart" and rows and len(row) < len(rows[-1]):
                above = rows[-1][len(row)]
                text = above if len(above) <= 450 else ""
            width = max(1, min(63, int(span.get(f"{_W}val", "1")))) if span is not None else 1
            row += [text] + [""] * (width - 1)
        rows.append(row)
    return rows


def read_docx(data: bytes, layout: bool = False, cap: int = 4096, max_ratio: float = 100.0) -> Parsed:
    """Paragraphs joined by empty lines; tables apart or, with layout, rendered where they stand."""
    from quirelake.layout.tokens import clean_cell, split_row

    z = open_zip(data, max_ratio)
    out = Parsed()
    names = set(z.namelist())
    if "word/document.xml" not in names:
        raise Refusal("corrupt", "no word/document.xml")
    if any(n.endswith("vbaProject.bin") for n in names):
        out.warnings.append("docx: macros present")
    body = _xml(z.read("word/document.xml")).find(f"{_W}body")
    blocks: list[str] = []
    heads: list[tuple[int, int, str]] = []
    for n in body if body is not None else []:
        if n.tag == f"{_W}p":
            text = _paragraph(n)
            if not text.strip():
                continue
            style = n.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"(?:Heading|berschrift|Titre|Titolo)\s?([1-9])", style.get(f"{_W}val", "")) if style is not None else None
            if level:
                heads.append((len(blocks), min(6, int(level[1])), " ".join(text.split())))
            blocks.append(text)
        elif n.tag == f"{_W}tbl":
            grid = [r for r in _grid(n) if any(c.strip() for c in r)]
            if len(grid) > 1:
                out.tables.append(capped_table(f"docx_t{len(out.tables)}", [c.strip() for c in grid[0]], [[c.strip() for c in r] for r in grid[1:]], out.warnings))
            if layout and grid:
                head = " | ".join(c for c in map(clean_cell, grid[0]) if c)
                lines = [x for r in grid[1:] for x in split_row(clean_cell(r[0]), [clean_cell(c) for c in r[1:] if c.strip()])]
                blocks.append("\n".join([head, *lines]))
    out.text = canonical("\n\n".join(blocks))
    lines, cursor, placed = out.text.split("\n"), 0, []
    for _, level, heading in heads:
        at = next((k for k in range(cursor, len(lines)) if " ".join(lines[k].split()) == heading), None)
        if at is not None:
            placed.append((at, level, heading))
            cursor = at + 1
    out.sections = sections_of(placed, lines, any_level=True)
    fields = {}
    for part, wanted in (("docProps/core.xml", CORE), ("docProps/app.xml", APP)):
        if part in names:
            for n in _xml(z.read(part)):
                name = n.tag.rpartition("}")[2]
                if name in wanted:
                    fields[f"docx:{name}"] = n.text
    out.extra = scrub(fields, cap, out.warnings)
    get = out.extra.get
    out.title, out.author, out.language, out.created, out.modified = (get(f"docx:{k}") for k in ("title", "creator", "language", "created", "modified"))
    return out


# RTF groups that hold no text, words that stand for characters.
_HIDDEN = frozenset("fonttbl colortbl stylesheet info pict object themedata datastore generator listtable listoverridetable rsidtbl latentstyles header footer headerl headerr footerl footerr xmlnstbl filetbl revtbl".split())
_CHARS = {"par": "\n", "line": "\n", "sect": "\n\n", "page": "\n\n", "tab": "\t", "cell": " | ", "row": "\n", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "emspace": " ", "enspace": " "}
_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.S)


def read_rtf(data: bytes) -> Parsed:
    """Text of an RTF document."""
    if not data.lstrip().startswith(b"{\\rtf"):
        raise Refusal("corrupt", "no RTF header")
    out, text = Parsed(), []
    stack: list[tuple[bool, int]] = []
    hidden, skip, pending, page = False, 1, 0, "cp1252"
    if m := re.search(rb"\\ansicpg(\d{3,5})", data[:4096]):
        page = f"cp{m[1].decode()}"
    for m in _RTF.finditer(data.decode("latin-1")):
        word, number, octet, symbol, brace, char = m.groups()
        if brace == "{":
            stack.append((hidden, skip))
        elif brace == "}":
            hidden, skip = stack.pop() if stack else (False, 1)
        elif symbol == "*":
            hidden = True
        elif word in _HIDDEN:
            hidden = True
        elif hidden:
            continue
        elif word == "uc":
            skip = int(number or 1)
        elif word == "u" and number:
            text.append(chr(int(number) % 65536))
            pending = skip
        elif word in _CHARS:
            text.append(_CHARS[word])
        elif pending and (octet or char):
            pending -= 1
        elif octet:
            try:
                text.append(bytes.fromhex(octet).decode(page, "replace"))
            except LookupError:
                text.append(bytes.fromhex(octet).decode("cp1252", "replace"))
        elif symbol in ("\\", "{", "}"):
            text.append(symbol)
        elif symbol == "~":
            text.append(" ")
        elif char:
            text.append(char)
    joined = "".join(text).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    out.text = canonical(joined)
    if re.search(rb"\\(?:object|objdata|objemb|objautlink)\b", data):
        out.warnings.append("rtf: embedded objects present")
    out.warnings.append("rtf: no markdown for this format")
    return out
