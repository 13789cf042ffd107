"""Makers of small documents for round trips."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(paragraphs: list[str], table: list[list[str]], title: str) -> bytes:
    p = lambda t, style="": f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    heading = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    body = "".join(p(t, heading if i == 0 else "") for i, t in enumerate(paragraphs))
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {_W}><w:body>{body}<w:tbl>{rows}</w:tbl></w:body></w:document>')
        z.writestr(
            "docProps/core.xml",
            '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">'
            f"<dc:title>{escape(title)}</dc:title></cp:coreProperties>",
        )
    return out.getvalue()


def pdf(pages: list[list[str]], title: str) -> bytes:
    """Lines of ASCII text, 14 points apart."""
    n = len(pages)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(n))}] /Count {n} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for i, lines in enumerate(pages):
        quoted = [line.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)") for line in lines]
        body = zlib.compress("\n".join(["BT /F1 10 Tf 14 TL 50 780 Td", *(f"({q}) Tj T*" for q in quoted), "ET"]).encode("latin-1", "replace"))
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode())
        objects.append(f"<< /Length {len(body)} /Filter /FlateDecode >>\nstream\n".encode() + body + b"\nendstream")
    objects.append(f"<< /Title ({title}) /CreationDate (D:20240305100000Z) >>".encode())
    out = b"%PDF-1.4\n"
    for k, o in enumerate(objects, 1):
        out += f"{k} 0 obj\n".encode() + o + b"\nendobj\n"
    return out + f"trailer\n<< /Root 1 0 R /Info {len(objects)} 0 R /Size {len(objects) + 1} >>\n%%EOF\n".encode()


@F.pandas_udf(BinaryType())
def docx_bytes(name: pd.Series, text: pd.Series, cells: pd.Series) -> pd.Series:
    return pd.Series([docx([n, *(t or "").split("\n")], [["key", "value"], *([str(i), c] for i, c in enumerate(cs))], n) for n, t, cs in zip(name, text, cells, strict=True)])


@F.pandas_udf(BinaryType())
def pdf_bytes(title: pd.Series, pages: pd.Series) -> pd.Series:
    return pd.Series([pdf([list(p) for p in ps], t) for t, ps in zip(title, pages, strict=True)])
