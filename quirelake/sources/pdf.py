"""Simple PDF documents: text of their pages with word boxes, and their properties. Encrypted ones are refused."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

from quirelake.sources.record import Parsed, Refusal, canonical, scrub

# White space and comments go before the token that a group names.
_TOKEN = re.compile(
    rb"(?:\s++|%[^\r\n]*+)*+(?:(<<|>>|\[|\]|\{|\})|(/[^\s<>\[\](){}/%]*)|(<[0-9A-Fa-f\s]*>)|(\()|([+-]?(?:\d+\.?\d*|\.\d+))|([^\s<>\[\](){}/%]+))", re.S
).match
_PLAIN, _OCTAL, _REFERENCE = (re.compile(x).match for x in (rb"[^()\\]+", rb"[0-7]{1,3}", rb"\s+(\d+)\s+R(?![A-Za-z0-9])"))
_STREAM = re.compile(rb"\s*stream\r?\n").match
_OBJECT, _TRAILER, _SCRIPT = re.compile(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b"), re.compile(rb"\btrailer\b"), re.compile(rb"/(?:JS|JavaScript)\b")
_ESCAPES = dict(zip(b"nrtbf", b"\n\r\t\b\f", strict=True))
_WORDS = {b"true": True, b"false": False, b"null": None}
_CP1252 = [bytes([c]).decode("cp1252", "replace") for c in range(256)]
#: Objects of a document that are kept once read; others are read again.
_KEPT = 1 << 14


class Name(str):
    """A PDF name without its slash."""


@dataclass
class Ref:
    number: int


class Lexer:
    """Values of PDF syntax, one at a time; operators come out as bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _string(self) -> bytes:
        out, depth, i, data, size = bytearray(), 1, self.at, self.data, len(self.data)
        while i < size:
            if m := _PLAIN(data, i):
                out += m[0]
                i = m.end()
                continue
            c = data[i]
            if c == 0x5C and i + 1 < size:
                i += 1
                e = data[i]
                if e in _ESCAPES:
                    out.append(_ESCAPES[e])
                elif 0x30 <= e <= 0x37:
                    m = _OCTAL(data, i)
                    out.append(int(m[0], 8) & 255)
                    i = m.end() - 1
                elif e not in b"\r\n":
                    out.append(e)
            elif c == 0x28:
                depth += 1
                out.append(c)
            elif c == 0x29:
                depth -= 1
                if not depth:
                    break
                out.append(c)
            else:
                out.append(c)
            i += 1
        self.at = i + 1
        return bytes(out)

    def next(self, depth: int = 0):
        """The next value; StopIteration at the end. `]` and `>>` come out as bytes for whoever collects."""
        m = _TOKEN(self.data, self.at)
        if m is None or depth > 64:
            raise StopIteration
        self.at = m.end()
        kind = m.lastindex
        token = m[kind]
        if kind == 5:
            if token.isdigit() and (ref := _REFERENCE(self.data, self.at)):
                self.at = ref.end()
                return Ref(int(token))
            return float(token) if b"." in token else int(token)
        if kind == 2:
            return _name(token)
        if kind == 4:
            return ("string", self._string())
        if kind == 6:
            return _WORDS.get(token, token)
        if kind == 3:
            raw = re.sub(rb"\s", b"", token[1:-1])
            return ("string", bytes.fromhex((raw + b"0" * (len(raw) % 2)).decode()))
        following, depth = self.next, depth + 1
        if token == b"[":
            out = []
            while (v := following(depth)) != b"]":
                out.append(v)
            return out
        if token == b"<<":
            found: dict = {}
            while (k := following(depth)) != b">>":
                v = following(depth)
                if v == b">>":
                    break
                if type(k) is Name:
                    found[k] = v
            return found
        return token


@lru_cache(4096)
def _name(token: bytes) -> Name:
    if b"#" in token:
        token = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), token)
    return Name(token[1:].decode("latin-1"))


class Document:
    """Objects by number, found by scanning, so that a broken cross-reference table doesn't matter."""

    def __init__(self, data: bytes, max_stream: int = 64 << 20):
        if b"%PDF-" not in data[:1024]:
            raise Refusal("corrupt", "no PDF header")
        self.data, self.max_stream = data, max_stream
        self.where = {int(m[1]): m.end() for m in _OBJECT.finditer(data)}
        self.read: dict[int, tuple] = {}
        self.packed: dict[int, object] = {}
        self.trailers = [d for m in _TRAILER.finditer(data) if isinstance(d := self._value(m.end())[0], dict)]
        for n in list(self.where):
            d = self.get(Ref(n))
            if isinstance(d, dict) and d.get("Type") == "XRef":
                self.trailers.append(d)
            elif isinstance(d, dict) and d.get("Type") == "ObjStm":
                self._unpack(n, d)
        if any("Encrypt" in t for t in self.trailers):
            raise Refusal("encrypted", "PDF")

    def _value(self, at: int) -> tuple:
        """The value at a place and where it ends."""
        lexer = Lexer(self.data, at)
        try:
            return lexer.next(), lexer.at
        except StopIteration:
            return None, lexer.at

    def _object(self, number: int) -> tuple:
        found = self.read.get(number)
        if found is None:
            found = self._value(self.where[number])
            if len(self.read) < _KEPT:
                self.read[number] = found
        return found

    def get(self, value):
        for _ in range(16):
            if not isinstance(value, Ref):
                return value
            value = self.packed[value.number] if value.number in self.packed else self._object(value.number)[0] if value.number in self.where else None
        return None

    def _unpack(self, number: int, d: dict) -> None:
        try:
            body = self.stream(Ref(number))
            heads = [int(x) for x in body[: self.get(d.get("First"))].split()]
            for n, at in zip(heads[::2], heads[1::2], strict=False):
                self.packed[n] = Lexer(body, self.get(d["First"]) + at).next()
        except (ValueError, TypeError, KeyError, StopIteration, zlib.error):
            return

    def stream(self, ref: Ref) -> bytes:
        """A stream's bytes; b"" for filters other than Flate, ASCIIHex and none."""
        if not isinstance(ref, Ref) or ref.number not in self.where:
            return b""
        d, at = self._object(ref.number)
        m = _STREAM(self.data, at)
        if not m or not isinstance(d, dict):
            return b""
        size = self.get(d.get("Length"))
        end = m.end() + size if isinstance(size, int) and self.data[m.end() + size : m.end() + size + 20].strip().startswith(b"endstream") else self.data.find(b"endstream", m.end())
        raw = self.data[m.end() : end]
        filters = self.get(d.get("Filter"))
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if f == "FlateDecode":
                try:
                    raw = zlib.decompressobj().decompress(raw, self.max_stream)
                except zlib.error:
                    return b""
            elif f == "ASCIIHexDecode":
                raw = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", raw).decode())
            else:
                return b""
        return raw

    def pages(self) -> list[dict]:
        root = next((r for t in reversed(self.trailers) if isinstance(r := self.get(t.get("Root")), dict)), None)
        out: list[dict] = []
        seen: set[int] = set()

        def visit(node, inherited: dict) -> None:
            if isinstance(node, Ref):
                if node.number in seen:
                    return
                seen.add(node.number)
            d = self.get(node)
            if not isinstance(d, dict):
                return
            own = inherited | {k: d[k] for k in ("Resources", "MediaBox") if k in d}
            if "Kids" in d:
                for kid in self.get(d["Kids"]) or []:
                    visit(kid, own)
            else:
                out.append(own | d)

        if root:
            visit(root.get("Pages"), {})
        if not out:
            out = [d for n in sorted(self.where) if isinstance(d := self.get(Ref(n)), dict) and d.get("Type") == "Page"]
        return out


def _to_unicode(cmap: bytes) -> dict[int, str]:
    text = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode()).decode("utf-16-be", "replace")
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([^>]*)>\s*<([^>]*)>", block):
            out[int(a, 16)] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([^>]*)>\s*<([^>]*)>\s*<([^>]*)>", block):
            base = text(c)
            for k in range(min(int(b, 16) - int(a, 16) + 1, 65536)):
                out[int(a, 16) + k] = base[:-1] + chr(ord(base[-1]) + k) if base else ""
    return out


def page_words(doc: Document, page: dict) -> list[tuple[float, float, float, float, str, float]]:
    """(x0, y0, x1, y1, text, size) of a page's words, y downwards, in the order of its content."""
    box = [float(doc.get(v)) for v in doc.get(page.get("MediaBox")) or [0, 0, 612, 792]]
    fonts: dict[str, tuple[dict[int, str], bool, dict[int, float]]] = {}
    resources = doc.get(page.get("Resources")) or {}
    for name, ref in (doc.get(resources.get("Font")) or {}).items():
        f = doc.get(ref) or {}
        cmap = _to_unicode(doc.stream(f["ToUnicode"])) if isinstance(f.get("ToUnicode"), Ref) else {}
        first, widths = doc.get(f.get("FirstChar")), doc.get(f.get("Widths"))
        wide = {first + k: float(doc.get(w) or 0) for k, w in enumerate(widths)} if isinstance(widths, list) and isinstance(first, int) else {}
        fonts[name] = (cmap, f.get("Subtype") == "Type0", wide)
    contents = page.get("Contents")
    refs = contents if isinstance(contents, list) else doc.get(contents) if isinstance(doc.get(contents), list) else [contents]
    body = b"\n".join(doc.stream(r) for r in refs if isinstance(r, Ref))
    words: list[tuple[float, float, float, float, str, float]] = []
    identity = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    mul = lambda m, n: (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])
    ctm, saved, tm, line = identity, [], identity, identity
    font, size, leading = "", 10.0, 0.0
    args: list = []
    lexer = Lexer(body)

    def show(raw: bytes) -> None:
        nonlocal tm
        cmap, double, wide = fonts.get(font, ({}, False, {}))
        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)] if double else list(raw)
        word, start, at = "", None, mul(tm, ctm)
        high = abs(size * at[3]) or size

        def close(end: float) -> None:
            nonlocal word, start
            if word:
                a, b = mul((1, 0, 0, 1, start, 0), at), mul((1, 0, 0, 1, end, 0), at)
                words.append((a[4] - box[0], box[3] - a[5] - 0.8 * high, b[4] - box[0], box[3] - a[5] + 0.2 * high, word, high))
            word, start = "", None

        x = 0.0
        for c in codes:
            ch = cmap.get(c) or (chr(c) if double else _CP1252[c])
            step = wide.get(c, 500.0) / 1000.0 * size
            if ch.isspace():
                if word:
                    close(x)
                start = None
            else:
                if start is None:
                    start = x
                word += ch
            x += step
        close(x)
        tm = mul((1, 0, 0, 1, x, 0), tm)

    while True:
        try:
            v = lexer.next()
        except StopIteration:
            break
        if not isinstance(v, bytes):
            args.append(v)
            continue
        num = [float(a) for a in args if type(a) is float or type(a) is int]
        strings = [a[1] for a in args if type(a) is tuple]
        if v == b"q":
            saved.append(ctm)
        elif v == b"Q" and saved:
            ctm = saved.pop()
        elif v == b"cm" and len(num) == 6:
            ctm = mul(tuple(num), ctm)
        elif v == b"BT":
            tm = line = identity
        elif v == b"Tf" and num:
            font, size = next((str(a) for a in args if isinstance(a, Name)), font), num[-1]
        elif v == b"TL" and num:
            leading = num[0]
        elif v in (b"Td", b"TD") and len(num) == 2:
            leading = -num[1] if v == b"TD" else leading
            tm = line = mul((1, 0, 0, 1, num[0], num[1]), line)
        elif v == b"Tm" and len(num) == 6:
            tm = line = tuple(num)
        elif v in (b"T*", b"'", b'"'):
            tm = line = mul((1, 0, 0, 1, 0, -leading), line)
            if strings:
                show(strings[-1])
        elif v == b"Tj" and strings:
            show(strings[-1])
        elif v == b"TJ" and args and isinstance(args[-1], list):
            for a in args[-1]:
                if isinstance(a, tuple):
                    show(a[1])
                elif isinstance(a, int | float):
                    tm = mul((1, 0, 0, 1, -a / 1000.0 * size, 0), tm)
        elif v == b"BI":
            end = re.compile(rb"\sEI(?=\s)").search(body, lexer.at)
            lexer.at = end.end() if end else len(body)
        args = []
    return words


def words_text(words: list[tuple]) -> str:
    """Lines of words at one height, from the top."""
    lines: list[list[tuple]] = []
    for w in sorted(words, key=lambda w: (round(w[3], 1), w[0])):
        if lines and abs(lines[-1][-1][3] - w[3]) <= 0.3 * max(w[5], 1.0):
            lines[-1].append(w)
        else:
            lines.append([w])
    return "\n".join(" ".join(w[4] for w in sorted(ln, key=lambda w: w[0])) for ln in lines)


def _text(value) -> str | None:
    if not isinstance(value, tuple):
        return None
    raw = value[1]
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")


def iso_date(value: str | None) -> str | None:
    """ISO 8601 of a PDF date, as functions.text.pdf_date."""
    m = re.match(r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(.*)$", value or "", re.S)
    if not m:
        return None
    y, mo, d, h, mi, s, zone = m.groups()
    out = y + (f"-{mo}" if mo else "") + (f"-{d}" if d else "")
    if not h:
        return out
    z = re.match(r"^([+-]\d{2})(\d{2})?$", zone.replace("'", ""))
    return f"{out}T{h}:{mi or '00'}:{s or '00'}" + (f"{z[1]}:{z[2] or '00'}" if z else "Z")


def read_pdf(data: bytes, cap: int = 4096, max_pages: int = 10_000) -> Parsed:
    """Text by page, joined by empty lines."""
    doc = Document(data)
    pages = doc.pages()
    if len(pages) > max_pages:
        raise Refusal("exhausted", "max_pages", max_pages, len(pages))
    out = Parsed(page_count=len(pages))
    texts = [canonical(words_text(page_words(doc, p))) for p in pages]
    out.text = canonical("\n\n".join(texts))
    at, cursor = 1, 0
    for i, t in enumerate(texts):
        found = out.text.find(t, cursor) if t else -1
        if found >= 0:
            at = 1 + out.text.count("\n", 0, found)
            cursor = found + len(t)
        out.pages.append({"index": i, "text": t, "line_start": at if found >= 0 else None, "line_end": at + t.count("\n") if found >= 0 else None})
    info = next((d for t in reversed(doc.trailers) if isinstance(d := doc.get(t.get("Info")), dict)), {})
    told = {k: _text(doc.get(v)) for k, v in info.items()}
    out.extra = scrub({f"pdf:{k.lower()}": told.get(k) for k in ("Producer", "Creator", "Subject", "Keywords")}, cap, out.warnings)
    out.title, out.author = told.get("Title") or None, told.get("Author") or None
    out.created, out.modified = iso_date(told.get("CreationDate")), iso_date(told.get("ModDate"))
    if _SCRIPT.search(data):
        out.warnings.append("pdf: embedded JavaScript")
    return out
