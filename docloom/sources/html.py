"""HTML: a forgiving tree builder on the standard tokenizer, and what is read from its tree."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from docloom.sources.structure import Structure

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("p div article section h1 h2 h3 h4 h5 h6 ul ol li blockquote pre table tr header footer main aside nav figure figcaption br hr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A tag that begins ends these, up to the element named last.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "thead", "tbody", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
_NEVER = frozenset("script style noscript iframe svg canvas video audio object embed".split())
_AROUND = frozenset("nav footer aside header".split())
#: What a class or id of something around the text begins with.
_SKIP_NAMES = re.compile("|".join(sorted("gdpr cookie popup modal newsletter recommended related share social widget sidebar comment banner ad menu nav header footer".split())), re.I)
_SKIP_ROLES = frozenset("navigation banner contentinfo complementary".split())
_MAIN_IDS = ("content", "main", "main-content", "article", "post", "entry")
_MAIN_CLASSES = ("content", "main-content", "article", "post-content", "entry-content")
#: An ampersand that begins no character reference with its semicolon; scripts and styles hold no references.
_LONE_AMPERSAND = re.compile(r"(<(script|style)\b.*?</\2)|&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)", re.I | re.S)
_LANGUAGES = frozenset("bash c cpp csharp css go golang html java javascript js json kotlin markdown php python ruby rust shell sql swift ts typescript xml yaml".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def elements(self):
        return [c for c in self.children if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    def walk(self):
        stack = [self]
        while stack:
            x = stack.pop()
            yield x
            stack.extend(reversed(x.elements()))


class _Builder(HTMLParser):
    def __init__(self, max_depth: int):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open, self.max_depth = [self.root], max_depth

    def _end(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return self._end(tags, within)
            if self.open[k].tag in within:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body", "head"):
            for x in self.open:
                if x.tag == tag:
                    x.attrs = {k: v or "" for k, v in attrs} | x.attrs
                    return
        if tag in _CLOSES_P:
            self._end(("p",), ("td", "th", "table", "button", "div", "section", "article", "li", "blockquote", "body"))
        if tag in _ENDS:
            self._end(*_ENDS[tag])
        if tag == "tr" and self.open[-1].tag == "table":
            self._push(Node("tbody"))
        node = Node(tag, {k: v if v is not None else "" for k, v in reversed(attrs)})
        self._push(node, tag in _VOID)

    def _push(self, node: Node, void: bool = False) -> None:
        self.open[-1].children.append(node)
        if not void and len(self.open) < self.max_depth:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            return self.handle_starttag("br", [])
        if tag in _VOID or tag in ("body", "html"):
            return None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return None
            if self.open[k].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return None
        return None

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(source: str, max_depth: int = 512) -> Node:
    b = _Builder(max_depth)
    b.feed(source)
    b.close()
    return b.root


def language_of(value: str) -> str:
    """The programming language that a class attribute names."""
    for name in value.split():
        for prefix in ("language-", "lang-", "highlight-", "brush:"):
            if name.startswith(prefix):
                return name[len(prefix) :].strip()
    return next((x.lower() for x in value.split() if x.lower() in _LANGUAGES), "")


class _Reader:
    def __init__(self, out: Structure, readability: bool, base_url: str | None):
        self.out, self.readability, self.base = out, readability, base_url

    def skips(self, n: Node) -> bool:
        if n.tag in _NEVER or (self.readability and n.tag in _AROUND):
            return True
        a = n.attrs
        if any(_SKIP_NAMES.match(a[k]) for k in ("class", "id") if k in a) or any(a[k] in ("", "true") for k in ("hidden", "aria-hidden") if k in a):
            return True
        style = a.get("style", "")
        return "display:none" in style or "display: none" in style or "visibility:hidden" in style or a.get("role") in _SKIP_ROLES

    def absolute(self, url: str) -> str:
        return urljoin(self.base, url) if self.base else url

    def read(self, n: Node) -> None:
        if self.skips(n):
            return
        t, a, out = n.tag, n.attrs, self.out
        if re.fullmatch("h[1-6]", t):
            if text := n.text().strip():
                out.add_heading(int(t[1]), text, a.get("id", ""))
        elif t == "a":
            url, text = a.get("href", ""), n.text().strip()
            if url and url != "#" and not url.startswith("javascript:") and text:
                out.add_link(text, self.absolute(url))
        elif t == "img":
            url = a.get("src") or a.get("data-src", "")
            if url and a.get("width") not in ("0", "1") and a.get("height") not in ("0", "1"):
                out.add_image(a.get("alt", ""), self.absolute(url), a.get("title", ""))
        elif t == "table":
            self.table(n)
            return
        elif t in ("ul", "ol"):
            self.list_(n)
            return
        elif t == "pre":
            self.code(n)
            return
        for c in n.elements():
            self.read(c)

    def table(self, n: Node) -> None:
        headers: list[str] = []
        rows: list[list[str]] = []
        for part in n.elements():
            for k, tr in enumerate(x for x in part.elements() if x.tag == "tr"):
                heads, cells = ([c.text().strip() for c in tr.elements() if c.tag == tag] for tag in ("th", "td"))
                if part.tag == "thead" and not k:
                    headers += heads + cells
                elif part.tag in ("tbody", "tfoot"):
                    if heads and not cells:
                        headers += heads if not headers else []
                    if cells:
                        rows.append(cells)
        if headers or rows:
            self.out.add_table(headers, rows)

    def list_(self, n: Node) -> None:
        items = [c for c in n.elements() if c.tag == "li"]
        if items:
            pos = self.out.add_list(n.tag == "ol")
            for li in items:
                self.item(li, pos, None, 0)

    def item(self, li: Node, pos: int, parent: int | None, depth: int) -> None:
        boxes = [c for c in li.elements() if c.tag == "input" and c.attrs.get("type") == "checkbox"]
        ident = self.out.add_item(pos, parent, depth, li.text().strip(), "checked" in boxes[-1].attrs if boxes else None)
        for c in li.elements():
            if c.tag in ("ul", "ol"):
                for x in c.elements():
                    if x.tag == "li":
                        self.item(x, pos, ident, depth + 1)

    def code(self, n: Node) -> None:
        inner = next((c for c in n.elements() if c.tag == "code"), None)
        language = language_of(inner.attrs.get("class", "")) if inner else ""
        content = (inner or n).text()
        if content.strip():
            self.out.add_code(language or language_of(n.attrs.get("class", "")), content, content.count("\n") + 1)

    def readable(self, n: Node) -> str:
        parts: list[str] = []

        def visit(x) -> None:
            if isinstance(x, str):
                if text := x.strip():
                    parts.append(text + " ")
                return
            if self.skips(x):
                return
            block = x.tag in _BLOCK
            if block and parts:
                parts.append("\n")
            for c in x.children:
                visit(c)
            if block:
                parts.append("\n")

        visit(n)
        return clean_text("".join(parts))


def clean_text(s: str) -> str:
    s = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", s))
    return "\n".join(line.strip() for line in s.split("\n")).strip()


def _main(root: Node) -> Node:
    """The first element, in the order of the document, that passes the first test that any passes; an id must be one of the names, a class hold one."""

    def said(n: Node, attribute: str) -> str:
        return (n.attrs.get(attribute) or "").lower()

    nodes = [n for n in root.walk() if n.tag != "#document"]
    for test in (
        lambda n: n.tag == "main",
        lambda n: n.tag == "article",
        lambda n: said(n, "role") == "main",
        lambda n: said(n, "id") in _MAIN_IDS,
        lambda n: any(part in word for word in said(n, "class").split() for part in _MAIN_CLASSES),
        lambda n: n.tag == "body",
    ):
        for n in nodes:
            if test(n):
                return n
    return root


def parse(source: str, readability: bool = True, base_url: str | None = None, max_depth: int = 512, open_references: bool = True) -> Structure:
    """The structure of an HTML text; with readability only that of its main part, without what surrounds it.

    With open_references some character references count without their
    semicolon, as in browsers; else what has none is text as it is written.
    """
    root = tree(source if open_references else _LONE_AMPERSAND.sub(lambda m: m[1] or "&amp;", source), max_depth)
    out = Structure(line_count=source.count("\n") + 1)
    out.title = next((t for n in root.walk() if n.tag == "title" and (t := n.text().strip())), "")
    body = next((n for n in root.walk() if n.tag == "body"), root)
    top = _main(root) if readability else body
    reader = _Reader(out, readability, base_url)
    reader.read(top)
    out.sections_from_headings(with_lines=False)
    out.readable_text = reader.readable(top)
    return out
