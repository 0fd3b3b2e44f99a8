"""What every parser returns: the structure of one document, and its Spark schema."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from pyspark.sql import types as T

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Element tables and the columns of each, but for doc_id; pos is the place in the document.  A section's path has
#: the section_ids from the top down to its own; the sections below it are those up to `last`, and the code blocks
#: of all these are those from code_from to before code_to.
ELEMENTS = {
    "headings": _struct(pos=_I, level=_I, text=_S, id=_S, line=_I),
    "sections": _struct(section_id=_I, pos=_I, title=_S, level=_I, parent_id=_I, start_line=_I, end_line=_I, indexed=_B, path=T.ArrayType(_I), last=_I, code_from=_I, code_to=_I),
    "code_blocks": _struct(pos=_I, section_id=_I, language=_S, content=_S, lines=_I),
    "links": _struct(pos=_I, text=_S, url=_S),
    "images": _struct(pos=_I, alt_text=_S, url=_S, title=_S),
    "tables": _struct(pos=_I, headers=T.ArrayType(_S), rows=T.ArrayType(T.ArrayType(_S))),
    "lists": _struct(pos=_I, ordered=_B),
    "list_items": _struct(list_pos=_I, item_id=_I, parent_item_id=_I, depth=_I, text=_S, checked=_B),
}
SCALARS = {"title": _S, "readable_text": _S, "line_count": _I, "metadata": _S, "parse_error": _S}


@dataclass
class Structure:
    """One parsed document; metadata is JSON."""

    title: str = ""
    readable_text: str = ""
    line_count: int = 0
    metadata: str | None = None
    parse_error: str | None = None
    headings: list[dict] = field(default_factory=list)
    sections: list[dict] = field(default_factory=list)
    code_blocks: list[dict] = field(default_factory=list)
    links: list[dict] = field(default_factory=list)
    images: list[dict] = field(default_factory=list)
    tables: list[dict] = field(default_factory=list)
    lists: list[dict] = field(default_factory=list)
    list_items: list[dict] = field(default_factory=list)

    def add_heading(self, level: int, text: str, ident: str = "", line: int = 0) -> None:
        self.headings.append({"pos": len(self.headings), "level": level, "text": text, "id": ident, "line": line})

    def add_code(self, language: str, content: str, lines: int, section_id: int | None = None) -> None:
        self.code_blocks.append({"pos": len(self.code_blocks), "section_id": section_id, "language": language, "content": content, "lines": lines})

    def add_link(self, text: str, url: str) -> None:
        self.links.append({"pos": len(self.links), "text": text, "url": url})

    def add_image(self, alt: str, url: str, title: str = "") -> None:
        self.images.append({"pos": len(self.images), "alt_text": alt, "url": url, "title": title})

    def add_table(self, headers: list[str], rows: list[list[str]]) -> None:
        self.tables.append({"pos": len(self.tables), "headers": headers, "rows": rows})

    def add_list(self, ordered: bool) -> int:
        self.lists.append({"pos": len(self.lists), "ordered": ordered})
        return len(self.lists) - 1

    def add_item(self, list_pos: int, parent: int | None, depth: int, text: str, checked: bool | None) -> int:
        ident = len(self.list_items)
        self.list_items.append({"list_pos": list_pos, "item_id": ident, "parent_item_id": parent, "depth": depth, "text": text, "checked": checked})
        return ident

    def add_section(self, title: str, level: int, parent: int | None, start: int = 0, end: int = 0, indexed: bool = True) -> int:
        ident = len(self.sections)
        self.sections.append({"section_id": ident, "pos": ident, "title": title, "level": level, "parent_id": parent, "start_line": start, "end_line": end, "indexed": indexed, "path": [*(self.sections[parent]["path"] if parent is not None else []), ident], "last": ident, "code_from": 0, "code_to": 0})
        return ident

    def sections_from_headings(self, with_lines: bool) -> None:
        """A section for each heading: it ends before the next one of its level or above; of equal titles only the last is indexed."""
        open_: list[int] = []
        for h in self.headings:
            while open_ and self.sections[open_[-1]]["level"] >= h["level"]:
                done = open_.pop()
                if with_lines:
                    self.sections[done]["end_line"] = h["line"] - 1
            open_.append(self.add_section(h["text"], h["level"], open_[-1] if open_ else None, h["line"] if with_lines else 0, self.line_count if with_lines else 0))
        last = {s["title"]: s["section_id"] for s in self.sections}
        for s in self.sections:
            s["indexed"] = last[s["title"]] == s["section_id"]

    def finish(self) -> Structure:
        """What lies below each section; sections and code blocks are in the order of the document."""
        for s in reversed(self.sections):
            if s["parent_id"] is not None:
                up = self.sections[s["parent_id"]]
                up["last"] = max(up["last"], s["last"])
        owner = [-1 if c["section_id"] is None else c["section_id"] for c in self.code_blocks]
        for s in self.sections:
            s["code_from"], s["code_to"] = bisect_left(owner, s["section_id"]), bisect_right(owner, s["last"])
        return self

    def code_to_sections(self, lines: list[int]) -> None:
        """Puts each code block into the section whose heading comes last before it; lines: where each block begins."""
        at = -1
        for block, line in zip(self.code_blocks, lines):
            while at + 1 < len(self.headings) and self.headings[at + 1]["line"] <= line:
                at += 1
            block["section_id"] = at if at >= 0 else None
