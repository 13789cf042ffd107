"""What a reader returns, and the typed refusals."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field


class Refusal(Exception):
    """A document that is not read; kind is one of unsupported, corrupt, encrypted, exhausted."""

    def __init__(self, kind: str, what: str, limit: float | None = None, observed: float | None = None):
        super().__init__(f"{kind}: {what}")
        self.kind, self.what, self.limit, self.observed = kind, what, limit, observed


@dataclass
class Parsed:
    text: str = ""
    title: str | None = None
    author: str | None = None
    language: str | None = None
    created: str | None = None
    modified: str | None = None
    page_count: int | None = None
    extra: dict[str, str] = field(default_factory=dict)
    pages: list[dict] = field(default_factory=list)
    sections: list[dict] = field(default_factory=list)
    tables: list[dict] = field(default_factory=list)
    markdown: str | None = None
    warnings: list[str] = field(default_factory=list)


def canonical(text: str) -> str:
    """As functions.text.canonicalize, for readers."""
    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")
    text = "\n".join(line.rstrip() for line in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


_HOSTILE = re.compile(r"[\x00-\x08\x0a-\x1f\x7f-\x9f‪-‮⁦-⁩]")


def scrub(fields: dict[str, str | None], cap: int, warnings: list[str]) -> dict[str, str]:
    """Fields that are safe to show, cut at the cap; what was dropped or cut is counted."""
    kept, dropped, cut = {}, 0, 0
    for k, v in fields.items():
        v = (v or "").strip()
        if not v:
            continue
        if _HOSTILE.search(v):
            dropped += 1
            continue
        cut += len(v) > cap
        kept[k] = v[:cap]
    if dropped:
        warnings.append(f"metadata: {dropped} values dropped for NUL / control / bidi-override characters")
    if cut:
        warnings.append(f"metadata: {cut} values truncated")
    return kept


def sections_of(heads: list[tuple[int, int, str]], lines: list[str], any_level: bool = False) -> list[dict]:
    """heads: (line, level, heading), lines 0-based; a section ends before the next heading of its level or above."""
    out = []
    for i, (at, level, heading) in enumerate(heads):
        end = next((b for b, other, _ in heads[i + 1 :] if any_level or other <= level), len(lines))
        out.append({"heading": heading, "level": level, "text": "\n".join(lines[at + 1 : end]).strip(), "line_start": at + 1, "line_end": end})
    return out


def capped_table(hint: str, headers: list[str], rows: list[list[str]], warnings: list[str], page: int | None = None, cell: int = 1024, max_rows: int = 5000, max_cols: int = 64) -> dict:
    """Rows padded and cut to the headers, cells and sizes capped."""
    if len(rows) > max_rows or len(headers) > max_cols:
        warnings.append(f"tables: {hint} cut to its caps")
    headers = [h[:cell] for h in headers[:max_cols]]
    n = len(headers)
    return {"client_table_hint": hint, "title": None, "headers": headers, "rows": [[c[:cell] for c in (r + [""] * n)[:n]] for r in rows[:max_rows]], "page": page, "bbox": None}
