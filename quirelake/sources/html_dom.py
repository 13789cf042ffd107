"""HTML by the standard library's tokenizer: text, headings, tables and sanitised Markdown."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

from quirelake.functions.html import DENIED_TAGS, closed_only
from quirelake.functions.text import URL_SCHEMES
from quirelake.sources.record import Parsed, Refusal, canonical, capped_table, scrub, sections_of

# Elements without end tags, those that end an open one of their kind, attributes that are removed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_OPEN = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = frozenset("p div table ul ol blockquote h1 h2 h3 h4 h5 h6 section article header footer nav main aside pre form fieldset figure dl".split())
DENIED_ATTRIBUTES = frozenset("style srcset formaction background ping nonce integrity".split())
DENIED = frozenset(DENIED_TAGS)


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings


class _Tree(HTMLParser):
    def __init__(self, max_depth: int):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.max_depth, self.comments = max_depth, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        implied = ENDS_OPEN.get(tag, set())
        if tag in BLOCKS:
            implied = implied | {"p"}
        if len(self.open) > 1 and self.open[-1].tag in implied:
            self.open.pop()
            if tag == "tr" and self.open[-1].tag == "tr":
                self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            if len(self.open) > self.max_depth:
                raise Refusal("exhausted", "max_recursion_depth", self.max_depth, len(self.open))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def handle_comment(self, data: str) -> None:
        self.comments += 1


def parse(html: str, max_depth: int = 256, bare: bool = True) -> tuple[Node, int]:
    """The tree and the number of comments. Depth is bounded, so that what walks it may recurse. References without a semicolon count as in browsers, unless bare is false."""
    tree = _Tree(max_depth)
    tree.feed(html if bare else closed_only(html))
    tree.close()
    return tree.root, tree.comments


def walk(node: Node, skip: frozenset[str] = frozenset()):
    for child in node.children:
        yield child
        if isinstance(child, Node) and child.tag not in skip:
            yield from walk(child, skip)


def text_nodes(node: Node) -> list[str]:
    """Visible text, a string a node."""
    hidden = frozenset(("script", "style", "head", "title", "template", "noscript"))
    return [x.strip() for x in walk(node, hidden) if isinstance(x, str) and x.strip()]


def inner_text(node: Node) -> str:
    return re.sub(r"\s+", " ", " ".join(x for x in walk(node, frozenset(("script", "style"))) if isinstance(x, str))).strip()


def tables(root: Node, warnings: list[str], max_tables: int = 50) -> list[dict]:
    """Top-level tables with a header and a row or more; the hint counts all tables."""
    found = [n for n in walk(root, frozenset(("table",))) if isinstance(n, Node) and n.tag == "table"]
    out = []
    for k, table in enumerate(found):
        inside = [n for n in walk(table, frozenset(("table",))) if isinstance(n, Node)]
        cells = lambda tr: [(c.tag, inner_text(c)) for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")]
        part = lambda tag: [r for n in inside if n.tag == tag for r in n.children if isinstance(r, Node) and r.tag == "tr"]
        head, body = part("thead"), part("tbody")
        rows = [cells(r) for r in (body or [n for n in inside if n.tag == "tr" and n not in head])]
        rows = [r for r in rows if r]
        header = [t for _, t in cells(head[0])] if head else None
        kept = []
        for r in rows:
            texts = [t for _, t in r]
            if header is None and all(tag == "th" for tag, _ in r):
                header = texts
            elif texts != header:
                kept.append(texts)
        if header is None and kept:
            header, kept = kept[0], kept[1:]
        if header and kept:
            out.append(capped_table(f"html_dom_t{k}", header, kept, warnings))
    if len(out) > max_tables:
        warnings.append(f"tables: {len(out) - max_tables} beyond the cap omitted")
    return out[:max_tables]


def _scheme(url: str) -> str:
    m = re.match(r"^([A-Za-z][A-Za-z0-9+.\-]*):", url.strip())
    return m[1].lower() if m else ""


def markdown(root: Node, counts: Counter | None = None) -> str:
    """ATX headings, `-` lists, links of safe schemes; denied elements go with their content, images leave their alt text."""
    counts = Counter() if counts is None else counts

    def many(node: Node, depth: int) -> str:
        return "".join(one(c, depth) for c in node.children)

    def one(node: Node | str, depth: int) -> str:
        if isinstance(node, str):
            return re.sub(r"\s+", " ", node)
        tag = node.tag
        if tag in DENIED:
            counts[f"tag {tag}"] += 1
            return ""
        for name in node.attributes:
            if name.startswith("on"):
                counts["event attributes"] += 1
            elif name in DENIED_ATTRIBUTES or (":" in name and name not in ("xml:lang", "xml:base")):
                counts["attributes"] += 1
        if tag in ("head", "title"):
            return many(node, depth) if tag == "head" else ""
        if tag == "br":
            return "\n"
        if tag == "hr":
            return "\n\n---\n\n"
        if tag == "img":
            counts["images"] += 1
            return node.attributes.get("alt", "")
        inner = many(node, depth + (tag in ("ul", "ol")))
        if re.fullmatch(r"h[1-6]", tag):
            return f"\n\n{'#' * int(tag[1])} {' '.join(inner.split())}\n\n" if inner.strip() else ""
        if tag == "a":
            url = node.attributes.get("href", "").strip()
            if not inner.strip():
                return ""
            if _scheme(url) in URL_SCHEMES:
                return f"[{inner.strip()}]({url})"
            if url:
                counts[f"url {_scheme(url) or 'relative'}"] += 1
            return inner
        if tag in ("b", "strong", "i", "em", "code"):
            mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}[tag]
            body = inner.strip()
            return f"{mark}{body}{mark}" if body else inner
        if tag == "li":
            return f"\n{'  ' * max(0, depth - 1)}- {inner.strip()}"
        if tag in ("ul", "ol"):
            return f"\n{inner}\n" if depth else f"\n\n{inner}\n\n"
        if tag in ("td", "th"):
            return f" {inner.strip()} |"
        if tag == "tr":
            return f"\n|{inner}"
        if tag == "pre":
            return f"\n\n```\n{''.join(x for x in walk(node) if isinstance(x, str)).strip()}\n```\n\n"
        return f"\n\n{inner}\n\n" if tag in BLOCKS else inner

    lines = [x.strip() if not x.startswith("  ") or not x.strip().startswith("-") else x.rstrip() for x in many(root, 0).split("\n")]
    return canonical("\n".join(lines))


def scrub_links(md: str, counts: Counter | None = None) -> str:
    """Inline links and images of Markdown, parentheses in their URLs balanced: images and unsafe links become their text."""
    counts = Counter() if counts is None else counts
    out, at = [], 0
    for m in iter(lambda: re.compile(r"(!?)\[([^\]]*)\]\(").search(md, at), None):
        depth, k = 1, m.end()
        while k < len(md) and depth and md[k] != "\n":
            depth += (md[k] == "(") - (md[k] == ")")
            k += 1
        if depth:
            out.append(md[at : m.end()])
            at = m.end()
            continue
        url = md[m.end() : k - 1].strip().split(" ")[0].strip("<>")
        out.append(md[at : m.start()])
        if m[1]:
            counts["images"] += 1
            out.append(m[2])
        elif _scheme(url) in URL_SCHEMES:
            out.append(md[m.start() : k])
        else:
            counts[f"url {_scheme(url) or 'relative'}"] += 1
            out.append(m[2])
        at = k
    return "".join([*out, md[at:]])


def told(counts: Counter) -> list[str]:
    return [f"markdown: {n} {what} removed" for what, n in sorted(counts.items()) if n]


def read_html(text: str, emit_markdown: bool = True, cap: int = 4096, max_depth: int = 256, max_expansion: float = 3.0, bare: bool = True) -> Parsed:
    """Everything of an HTML document."""
    root, comments = parse(text, max_depth, bare)
    out = Parsed(text=canonical("\n".join(text_nodes(root))))
    nodes = [n for n in walk(root) if isinstance(n, Node)]
    first = lambda tag: next((n for n in nodes if n.tag == tag), None)
    title, top = first("title"), first("html")
    out.title = (inner_text(title) or None) if title else None
    out.language = (top.attributes.get("lang") or None) if top else None
    meta: dict[str, str] = {}
    for n in nodes:
        if n.tag == "meta":
            name = (n.attributes.get("name") or n.attributes.get("property") or "").strip().lower()
            value = n.attributes.get("content", "").strip()
            kept = name in ("description", "keywords", "author", "robots", "generator") or name.startswith(("og:", "twitter:", "article:"))
            is_url = name in ("og:url", "og:image", "twitter:url", "twitter:image")
            if kept and value and not (is_url and (value.startswith("//") or (":" in value and _scheme(value) not in URL_SCHEMES))):
                meta[f"html:{name}"] = value
    out.author = meta.get("html:author")
    out.created, out.modified = meta.get("html:article:published_time"), meta.get("html:article:modified_time")
    out.extra = scrub(meta, cap, out.warnings)
    lines, heads, cursor = out.text.split("\n"), [], 0
    for n in nodes:
        if re.fullmatch(r"h[1-6]", n.tag) and (name := inner_text(n)):
            at = next((k for k in range(cursor, len(lines)) if lines[k] and (name.startswith(lines[k]) or lines[k] == name)), None)
            if at is not None:
                heads.append((at, int(n.tag[1]), name))
                cursor = at + 1
    out.sections = sections_of(heads, lines)
    out.tables = tables(root, out.warnings)
    if emit_markdown:
        counts = Counter({"comments": comments} if comments else {})
        out.markdown = markdown(root, counts)
        if len(out.markdown) > max_expansion * max(len(out.text), 1) + 1024:
            raise Refusal("exhausted", "max_markdown_expansion_ratio", max_expansion, len(out.markdown) / max(len(out.text), 1))
        out.warnings += told(counts)
    return out
