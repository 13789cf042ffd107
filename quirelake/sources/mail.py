"""E-mail messages by the standard library."""

from __future__ import annotations

import re
from email import message_from_bytes, policy
from email.utils import parsedate_to_datetime

from quirelake.sources.html_dom import parse, text_nodes
from quirelake.sources.record import Parsed, canonical, scrub

# Headers that become metadata.
HEADERS = "From To Cc Bcc Reply-To Sender Subject Date Message-ID In-Reply-To References List-Id X-Mailer Content-Language Importance Priority".split()


def html_body_text(html: str) -> str:
    return "\n".join(text_nodes(parse(html)[0]))


def iso_date(value: str | None) -> str | None:
    try:
        return parsedate_to_datetime(value).isoformat() if value else None
    except (TypeError, ValueError, IndexError):
        return None


def read_mail(data: bytes, cap: int = 4096) -> Parsed:
    """Plain body before HTML; attachments are counted and named, not read."""
    message = message_from_bytes(data, policy=policy.default)
    out = Parsed()
    headers = {}
    for name in HEADERS:
        try:
            value = message.get(name)
            headers[name] = None if value is None else str(value)
        except (ValueError, LookupError, IndexError, AttributeError):
            headers[name] = None
    head = re.split(rb"\r?\n\r?\n", data, maxsplit=1)[0]
    if re.search(rb"=\?[^?]*\?[bqBQ]\?[^?]*(=0[aAdD]|DQo|Cg)", head):
        out.warnings.append("eml: encoded line break in a header")
    plain = html = None
    attached = []
    for part in message.walk():
        if part.is_multipart():
            continue
        if part.get_content_disposition() == "attachment" or part.get_filename():
            attached.append(part.get_filename() or "unnamed")
            continue
        kind = part.get_content_type()
        if kind in ("text/plain", "text/html"):
            raw = part.get_payload(decode=True) or b""
            try:
                body = raw.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                body = raw.decode("utf-8", "replace")
            if kind == "text/plain" and plain is None:
                plain = body
            elif kind == "text/html" and html is None:
                html = body
    out.text = canonical(plain if plain is not None and plain.strip() else html_body_text(html) if html else "")
    fields = {f"eml:{k.lower()}": v for k, v in headers.items()}
    fields |= {"eml:attachment_count": str(len(attached)) if attached else None, "eml:attachments": ", ".join(attached) or None}
    out.extra = scrub(fields, cap, out.warnings)
    out.title, out.author = out.extra.get("eml:subject"), out.extra.get("eml:from")
    out.created = iso_date(headers["Date"])
    return out
