"""HTML operators as Column expressions: no tree is built, so they stay in the JVM."""

from __future__ import annotations

import html as _html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirelake.functions.text import BIDI, metadata_url_ok, strip

# Elements.
BLOCK_TAGS = ("script", "style", "head", "title")
INLINE_TAGS = (
    "a abbr b big cite code em font i kbd mark nobr q s samp small span strike strong sub sup tt u var wbr"
).split()
DENIED_TAGS = "script style iframe object embed applet frame frameset noscript svg math link meta base template".split()
# Entities that the native path decodes; other references go through Python.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·"}


# Numeric references beyond the last code point by their length alone: parsing thousands of digits is refused.
_LONG = re.compile(r"&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,});?")


_CLOSED = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def closed_only(text: str) -> str:
    """The text with the ampersands escaped that do not begin a known reference ended by its semicolon."""
    return _CLOSED.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[0][1:]}", text)


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else _html.unescape(_LONG.sub("\ufffd", t)))


@F.pandas_udf(StringType())
def _unescape_closed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else _html.unescape(closed_only(_LONG.sub(lambda m: "\ufffd" if m[0].endswith(";") else m[0], t))))


def drop_comments(html: Column) -> Column:
    """An unterminated comment swallows the rest."""
    return F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")


def drop_blocks(html: Column, tags: tuple[str, ...] = BLOCK_TAGS) -> Column:
    """Elements with their content; an unclosed one swallows the rest."""
    return F.regexp_replace(html, rf"(?is)<({'|'.join(tags)})\b.*?(?:</\1[^>]*(?:>|\z)|\z)", "")


def unescape(text: Column, all_entities: bool = False, bare: bool = True) -> Column:
    """Decode character references; with all_entities, texts with others than the common ones go through Python. There, browsers' references without a semicolon count unless bare is false."""
    plain = text
    for entity, char in ENTITIES.items():
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    plain = F.replace(plain, F.lit("&amp;"), F.lit("&"))
    if not all_entities:
        return plain
    others = text.rlike(r"&(?!(?:lt|gt|quot|#39|nbsp|copy|middot|amp);)#?\w" + ("" if bare else "+;"))
    return F.coalesce((_unescape if bare else _unescape_closed)(F.when(others, text)), plain)


def html_to_text(html: Column, all_entities: bool = False, bare: bool = True) -> Column:
    """Text of an e-mail's HTML: cells end in " | ", paragraphs in a blank line, inline tags vanish and others are a space. all_entities and bare as in unescape."""
    t = drop_blocks(drop_comments(F.regexp_replace(html, r"\r\n?", "\n")))
    t = F.regexp_replace(t, r"(?i)</t[dh]\s*>", " | ")
    t = F.regexp_replace(t, r"(?i)</(?:p|div|table|blockquote|ul|ol|h[1-6])\s*>", "\n\n")
    t = F.regexp_replace(t, r"(?i)<br\b[^<>]*>|</(?:tr|li)\s*>", "\n")
    t = F.regexp_replace(t, rf"(?i)</?(?:{'|'.join(INLINE_TAGS)})(?=[\s/>])[^<>]*>", "")
    t = F.regexp_replace(t, r"<[^<>]*>", " ")
    t = F.regexp_replace(unescape(t, all_entities, bare), rf"[\x00-\x08\x0B-\x1F\x7F]|{BIDI}", "")
    t = F.regexp_replace(t, r"[\x09\x0B-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " ")
    t = F.regexp_replace(t, r"(?m)^[ |]+|[ |]+$", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def title(html: Column) -> Column:
    return strip(unescape(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title", 1)))


def language(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z0-9\-]+)""", 1), F.lit(""))


def comment_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?s)<!--.*?(?:-->|\z)")).cast("long")


def denied_counts(html: Column) -> Column:
    """map<tag, opening tags> of the tags that the sanitiser removes with their content, comments apart."""
    bare = drop_comments(html)
    pairs = [F.struct(F.lit(t).alias("key"), F.regexp_count(bare, F.lit(rf"(?i)<{t}(?=[\s/>])")).cast("long").alias("value")) for t in DENIED_TAGS]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"] > 0))


def links(html: Column) -> Column:
    """array<struct<href, text>> of anchors in order."""
    found = F.regexp_extract_all(drop_comments(html), F.lit(r"(?is)(<a\b[^>]*>.*?</a\s*>)"), 1)
    return F.transform(
        found,
        lambda a: F.struct(
            unescape(F.regexp_extract(a, r"""(?is)^<a\b[^>]*?\bhref\s*=\s*["']?([^"'>\s]*)""", 1)).alias("href"),
            strip(F.regexp_replace(a, r"<[^<>]*>", "")).alias("text"),
        ),
    )


def metas(html: Column) -> Column:
    """array<struct<name, content>> of meta tags in order: lower-cased name or property, stripped content, both present."""
    tags = F.regexp_extract_all(drop_comments(html), F.lit(r"(?is)(<meta\b[^>]*>)"), 1)
    attr = lambda m, name: strip(unescape(F.regexp_extract(m, rf"""(?is)\b(?:{name})\s*=\s*["']([^"']*)["']""", 1)))
    told = F.transform(tags, lambda m: F.struct(F.lower(attr(m, "name|property")).alias("name"), attr(m, "content").alias("content")))
    return F.filter(told, lambda m: (m["name"] != "") & (m["content"] != ""))


def meta_map(html: Column) -> Column:
    """The last content of each kept meta name; URL fields only with a safe scheme."""
    kept = F.filter(
        metas(html),
        lambda m: (m["name"].isin("description", "keywords", "author", "robots", "generator") | m["name"].rlike("^(og|twitter|article):"))
        & (~m["name"].rlike("^(og|twitter):(url|image)$") | metadata_url_ok(m["content"])),
    )
    names = F.array_distinct(F.transform(kept, lambda m: m["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(kept, lambda m: m["name"] == n), -1)["content"]))


def canonical_link(html: Column) -> Column:
    """href of the first canonical link, null if its scheme is not safe."""
    tag = F.regexp_extract(drop_comments(html), r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    href = strip(unescape(F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?([^"'>\s]*)""", 1)))
    return F.when((href != "") & metadata_url_ok(href), href)
