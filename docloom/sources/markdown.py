"""Markdown: blocks, then what stands inside them.

Covers front matter, ATX and setext headings, fenced and indented code, block
quotes, lists with tasks, tables, raw HTML, link definitions, and inside of
blocks escapes, code spans, links, images, automatic links and emphasis.
"""

from __future__ import annotations

import html
import json
import re

from docloom.sources.structure import Structure

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`]*)$|( {0,3})(~{3,})[ \t]*(.*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|)$")
_QUOTE = re.compile(r" {0,3}> ?(.*)$")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(<[^<>]*>|\S+)(?:[ \t]+(?:\"([^\"]*)\"|'([^']*)'|\(([^()]*)\)))?[ \t]*$")
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML_BLOCK = re.compile(r" {0,3}(?:<(?:script|pre|style|textarea)(?=[\s>]|$)|<!--|<\?|<![A-Za-z]|</?(?:address|article|aside|base|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|optgroup|option|p|param|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?=[\s/>]|$))", re.I)
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>|<!--.*?-->")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w.-]+)>")
_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


class _Inline:
    """Text, links and images of one run of inline Markdown."""

    def __init__(self, text: str, refs: dict[str, tuple[str, str]]):
        self.refs = refs
        self.found: list[tuple[str, ...]] = []
        self.nodes: list[list] = []  # text, whether it stands at the top
        self._run(text)

    @property
    def text(self) -> str:
        return "".join(n[0] for n in self.nodes)

    @property
    def direct(self) -> str:
        return "".join(n[0] for n in self.nodes if n[1])

    def _run(self, s: str) -> None:
        nodes, marks, i, n = self.nodes, [], 0, len(s)

        def put(text: str, direct: bool = True) -> None:
            if text:
                nodes.append([text, direct])

        while i < n:
            c = s[i]
            if c == "\\" and i + 1 < n and s[i + 1] in _PUNCTUATION:
                put(s[i + 1])
                i += 2
            elif c == "`":
                k = len(s) - i - len(s[i:].lstrip("`"))
                close = re.search(rf"(?<!`)`{{{k}}}(?!`)", s[i + k :])
                if close:
                    code = s[i + k : i + k + close.start()].replace("\n", " ")
                    put(code[1:-1] if len(code) > 1 and code[0] == code[-1] == " " and code.strip() else code, False)
                    i += k + close.end()
                else:
                    put("`" * k)
                    i += k
            elif c == "!" and s[i + 1 : i + 2] == "[" and (got := self._bracket(s, i + 1)):
                label, url, title, end = got
                inner = _Inline(label, self.refs)
                self.found.append(("image", inner.direct, url, title))
                self.found += inner.found
                put(inner.text, False)
                i = end
            elif c == "[" and (got := self._bracket(s, i)):
                label, url, title, end = got
                inner = _Inline(label, self.refs)
                self.found.append(("link", inner.direct, url))
                self.found += inner.found
                put(inner.text, False)
                i = end
            elif c == "<" and (m := _AUTO.match(s, i)):
                i = m.end()
            elif c == "<" and (m := _TAG.match(s, i)):
                i = m.end()
            elif c == "&" and (m := re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|\w+);").match(s, i)):
                put(html.unescape(m[0]))
                i = m.end()
            elif c in "*_" or s.startswith("~~", i):
                k = 1
                while i + k < n and s[i + k] == c:
                    k += 1
                a, b = s[i - 1] if i else " ", s[i + k] if i + k < n else " "
                left = not b.isspace() and (b not in _PUNCTUATION or a.isspace() or a in _PUNCTUATION)
                right = not a.isspace() and (a not in _PUNCTUATION or b.isspace() or b in _PUNCTUATION)
                opens, closes = left and (c != "_" or not right or a in _PUNCTUATION), right and (c != "_" or not left or b in _PUNCTUATION)
                left_over = k
                while closes and left_over:
                    for at in range(len(marks) - 1, -1, -1):
                        if marks[at][0] == c and marks[at][2]:
                            break
                    else:
                        break
                    used = min(2, marks[at][1], left_over) if c != "~" else min(marks[at][1], left_over)
                    for node in nodes[marks[at][3] + 1 :]:
                        node[1] = False
                    del marks[at + 1 :]
                    marks[at][1] -= used
                    nodes[marks[at][3]][0] = c * marks[at][1]
                    if not marks[at][1]:
                        marks.pop(at)
                    left_over -= used
                if left_over:
                    nodes.append([c * left_over, True])
                    if opens:
                        marks.append([c, left_over, True, len(nodes) - 1])
                i += k
            elif c == "\n":
                put(" ")
                i += 1
            else:
                m = re.compile(r"[^\\`!\[<&*_~\n]+").match(s, i)
                put(m[0] if m else c)
                i = m.end() if m else i + 1

    def _bracket(self, s: str, i: int) -> tuple[str, str, str, int] | None:
        """Label, URL, title and end of the link that begins with the bracket at i."""
        depth, j = 0, i
        while j < len(s):
            if s[j] == "\\":
                j += 1
            elif s[j] == "`" and (m := re.compile(r"(`+)[^`]*\1").match(s, j)):
                j = m.end() - 1
            elif s[j] == "[":
                depth += 1
            elif s[j] == "]":
                depth -= 1
                if not depth:
                    break
            j += 1
        else:
            return None
        label = s[i + 1 : j]
        m = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(([^()]*)\)))?\s*\)").match(s, j + 1)
        if m:
            clean = lambda x: html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", x))
            return label, clean(m[1] if m[1] is not None else m[2] or ""), clean(next((x for x in m.groups()[2:] if x is not None), "")), m.end()
        m = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(s, j + 1)
        key = " ".join(((m[1] if m and m[1].strip() else label)).casefold().split())
        if key in self.refs:
            return label, *self.refs[key], m.end() if m else j + 1
        return None


def _expand(line: str) -> str:
    """Tabs in the indentation as blanks up to the next multiple of four."""
    m = re.match(r"[ \t]*", line)[0]
    return m.expandtabs(4) + line[len(m) :] if "\t" in m else line


class _Blocks:
    def __init__(self, out: Structure, refs: dict[str, tuple[str, str]]):
        self.out, self.refs, self.ids, self.code_lines = out, refs, {}, []

    def anchor(self, text: str) -> str:
        base = "".join(c.lower() if c.isalnum() else c if c == "_" else "-" if c in " -" else "" for c in text.strip()) or "heading"
        name, k = base, 0
        while name in self.ids:
            k += 1
            name = f"{base}-{k}"
        self.ids[name] = True
        return name

    def inline(self, text: str) -> _Inline:
        got = _Inline(text, self.refs)
        for kind, *rest in got.found:
            (self.out.add_link if kind == "link" else self.out.add_image)(*rest)
        return got

    def heading(self, level: int, raw: str, line: int) -> None:
        text = self.inline(raw.strip()).text
        self.out.add_heading(level, text, self.anchor(text), line)

    def paragraph(self, rows: list[tuple[int, str]], texts: list[str] | None) -> None:
        while rows and (m := _DEFINITION.match(rows[0][1])):
            rows = rows[1:]
        if rows:
            text = self.inline("\n".join(r.strip() for _, r in rows)).text
            if texts is not None:
                texts.append(text)

    def run(self, rows: list[tuple[int, str]], texts: list[str] | None = None, owner: tuple[int | None, int] = (None, 0)) -> None:
        """Parses the lines of one container; texts gets the text of each of its blocks; owner: the list item around, and its depth."""
        i, n, para = 0, len(rows), []

        def flush() -> None:
            nonlocal para
            if para:
                self.paragraph(para, texts)
                para = []

        while i < n:
            no, raw = rows[i]
            line = _expand(raw)
            if not line.strip():
                flush()
                i += 1
                continue
            indent = len(line) - len(line.lstrip(" "))
            if indent >= 4 and not para:
                while i < n and (not rows[i][1].strip() or len(_expand(rows[i][1])) - len(_expand(rows[i][1]).lstrip(" ")) >= 4):
                    i += 1
                continue
            if indent >= 4:
                para.append((no, line))
                i += 1
                continue
            m = _FENCE.match(line)
            if m:
                flush()
                pad, mark, info = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
                close = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
                j, body = i + 1, []
                while j < n and not close.match(rows[j][1]):
                    text = rows[j][1]
                    k = 0
                    while k < len(pad) and text[k : k + 1] == " ":
                        k += 1
                    body.append(text[k:])
                    j += 1
                self.out.add_code(html.unescape(info.strip()), "".join(b + "\n" for b in body), len(body))
                self.code_lines.append(no)
                i = j + 1
                continue
            if m := _ATX.match(line):
                flush()
                self.heading(len(m[1]), re.sub(r"^#+$", "", m[2] or ""), no)
                i += 1
                continue
            if para and (m := _SETEXT.match(line)):
                text = "\n".join(r.strip() for _, r in para)
                first = para[0][0]
                para = []
                self.heading(1 if m[1][0] == "=" else 2, text, first)
                i += 1
                continue
            if _RULE.match(line):
                flush()
                i += 1
                continue
            if m := _QUOTE.match(line):
                flush()
                inner = []
                while i < n and rows[i][1].strip():
                    m = _QUOTE.match(_expand(rows[i][1]))
                    if not m and (not inner or not inner[-1][1].strip() or _ATX.match(rows[i][1]) or _FENCE.match(rows[i][1]) or _ITEM.match(rows[i][1]) or _RULE.match(rows[i][1])):
                        break
                    inner.append((rows[i][0], m[1] if m else rows[i][1]))
                    i += 1
                self.run(inner, texts, owner)
                continue
            m = _ITEM.match(line)
            if m and not (para and (not m[4] or (m[2][0].isdigit() and m[2][:-1] != "1"))):
                flush()
                i = self.list_(rows, i, texts, owner)
                continue
            if not para and _HTML_BLOCK.match(line):
                end = re.compile(r"</(?:script|pre|style|textarea)>", re.I) if re.match(r" {0,3}<(?:script|pre|style|textarea)", line, re.I) else re.compile("-->") if line.lstrip().startswith("<!--") else None
                while i < n and (end or rows[i][1].strip()):
                    i += 1
                    if end and end.search(rows[i - 1][1]):
                        break
                continue
            if para and len(para) == 1 and _DELIMITER.match(line) and "|" in para[0][1] + line and len(_cells(para[0][1])) == len(_cells(line)):
                header = [self.inline(c).text for c in _cells(para[0][1])]
                para, body = [], []
                i += 1
                while i < n and rows[i][1].strip() and not (_FENCE.match(rows[i][1]) or _ATX.match(rows[i][1]) or _QUOTE.match(rows[i][1]) or _RULE.match(rows[i][1])):
                    cells = [self.inline(c).text for c in _cells(rows[i][1])][: len(header)]
                    body.append(cells + [""] * (len(header) - len(cells)))
                    i += 1
                self.out.add_table(header, body)
                continue
            para.append((no, line))
            i += 1
        flush()

    def list_(self, rows: list[tuple[int, str]], i: int, texts: list[str] | None, owner: tuple[int | None, int]) -> int:
        """Parses the list that begins at row i; gives the row after it."""
        n = len(rows)
        kind = _ITEM.match(_expand(rows[i][1]))[2][-1]
        ordered = kind in ".)"
        pos = self.out.add_list(ordered)
        while i < n:
            m = _ITEM.match(_expand(rows[i][1]))
            if not m or m[2][-1] != kind or _RULE.match(rows[i][1]):
                break
            wide = m[3] or " "
            offset = len(m[1]) + len(m[2]) + (len(wide) if len(wide) <= 4 and m[4] else 1)
            inner = [(rows[i][0], (" " * (len(wide) - 1) if len(wide) > 4 else "") + (m[4] or ""))]
            i += 1
            while i < n:
                line = _expand(rows[i][1])
                if not line.strip():
                    inner.append((rows[i][0], ""))
                    i += 1
                    continue
                if len(line) - len(line.lstrip(" ")) >= offset:
                    inner.append((rows[i][0], line[offset:]))
                elif inner[-1][1].strip() and not (_ITEM.match(line) or _ATX.match(line) or _FENCE.match(line) or _QUOTE.match(line) or _RULE.match(line)):
                    inner.append((rows[i][0], line.lstrip()))  # a paragraph goes on without its indentation
                else:
                    break
                i += 1
            task = re.match(r"\[([ xX])\][ \t]+", inner[0][1])
            if task:
                inner[0] = (inner[0][0], inner[0][1][task.end() :])
            parent, depth = owner
            item = self.out.add_item(pos, parent, depth, "", None if not task else task[1] != " ")
            own: list[str] = []
            self.run(inner, own, (item, depth + 1))
            text = "".join(own)
            self.out.list_items[item]["text"] = text
            if texts is not None:
                texts.append(text)
        return i


def _cells(line: str) -> list[str]:
    line = line.strip()
    if line.startswith("|"):
        line = line[1:]
    if line.endswith("|") and not line.endswith("\\|"):
        line = line[:-1]
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def front_matter(lines: list[str]) -> tuple[dict | None, int]:
    """The YAML between two lines of dashes at the very begin, and the number of lines it takes."""
    if lines and re.match(r"---[ \t]*$", lines[0]):
        for j in range(1, len(lines)):
            if re.match(r"---[ \t]*$", lines[j]):
                import yaml

                try:
                    data = yaml.safe_load("\n".join(lines[1:j]))
                except yaml.YAMLError:
                    return None, j + 1
                return data if isinstance(data, dict) else None, j + 1
    return None, 0


def parse(source: str) -> Structure:
    """The structure of a Markdown text."""
    lines = source.replace("\r\n", "\n").split("\n")
    out = Structure(readable_text=source, line_count=len(lines))
    meta, skip = front_matter(lines)
    if meta is not None:
        out.metadata = json.dumps(meta, default=str, ensure_ascii=False)
    rows = [(k + 1, line) for k, line in enumerate(lines)][skip:]
    refs: dict[str, tuple[str, str]] = {}
    for _, line in rows:
        if m := _DEFINITION.match(line):
            refs.setdefault(" ".join(m[1].casefold().split()), (m[2].strip("<>"), next((x for x in m.groups()[2:] if x), "")))
    blocks = _Blocks(out, refs)
    blocks.run(rows)
    out.sections_from_headings(with_lines=True)
    out.code_to_sections(blocks.code_lines)
    out.title = next((h["text"] for h in out.headings if h["level"] == 1), "")
    return out
