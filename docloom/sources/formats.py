"""Formats of documents, and how to tell them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = {
    "markdown": ("md", "markdown", "mdown", "mkd"),
    "html": ("html", "htm", "xhtml"),
    "pdf": ("pdf",),
    "json": ("json",),
    "jsonl": ("jsonl", "ndjson"),
    "yaml": ("yaml", "yml"),
}
_OF = {e: f for f, es in EXTENSIONS.items() for e in es}


def detect(path: str, content: bytes) -> str:
    """By the extension; else by how the content begins; else Markdown."""
    m = re.search(r"\.([^./]+)$", path or "")
    if m and m[1].lower() in _OF:
        return _OF[m[1].lower()]
    head = content[:1024].lstrip()
    if head.startswith((b"<!", b"<html", b"<HTML")):
        return "html"
    if head.startswith(b"%PDF"):
        return "pdf"
    if head.startswith((b"{", b"[")):
        return "json"
    return "yaml" if head.startswith(b"---") else "markdown"


def detect_column(path: Column, content: Column) -> Column:
    """The same as a column expression over a path and the content as a string."""
    ext = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./]+)$", 1))
    out = None
    for name, es in EXTENSIONS.items():
        out = F.when(ext.isin(*es), name) if out is None else out.when(ext.isin(*es), name)
    head = F.regexp_replace(F.substring(F.coalesce(content, F.lit("")), 1, 1024), r"^\s+", "")
    out = out.when(head.startswith("<!") | head.startswith("<html") | head.startswith("<HTML"), "html")
    out = out.when(head.startswith("%PDF"), "pdf").when(head.startswith("{") | head.startswith("["), "json")
    return out.when(head.startswith("---"), "yaml").otherwise("markdown")
