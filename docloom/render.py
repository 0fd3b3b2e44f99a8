"""Text renderings of collected results, for the console."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Row


def tree(rows: Iterable[Row], title: str = "", lines: int | None = None) -> str:
    """The outline of one document from its rows in order."""
    rows = sorted(rows, key=lambda r: r["seq"])
    out = [f"{title} ({lines} lines)" if lines is not None else title] if title else []
    for i, r in enumerate(rows):
        bars = []
        for d in range(r["depth"] + 1):
            later = next((x["depth"] for x in rows[i + 1 :] if x["depth"] <= d), -1)
            bars.append(("├── " if later == d else "└── ") if d == r["depth"] else ("│   " if later == d else "    "))
        if r["type"] == "code":
            out.append("".join(bars) + f"[{r['text']}: {r['meta']}]")
            continue
        out.append("".join(bars) + f"{'#' * r['level']} {r['text']} ({r['start_line']}-{r['end_line']})")
        if r["preview"]:
            out.append("".join(b if b in ("│   ", "    ") else ("│   " if b == "├── " else "    ") for b in bars) + f'    "{r["preview"]}"')
    return "\n".join(out)


def search(rows: Iterable[Row], term: str) -> str:
    """Matches grouped by document."""
    rows = list(rows)
    out, last = [f'Found {len(rows)} matches for "{term}":'], None
    for r in rows:
        if r["doc_id"] != last:
            last = r["doc_id"]
            out += ["", f"{last}:"]
        out += [f"  ## {r['section']} (lines {r['lines']})", f"     \"{r['match']}\""]
    return "\n".join(out)


def files(rows: Iterable[Row], root: str = "") -> str:
    """Files as a tree of their directories, which come first and both in the order of their names; each with its size, headings and previews."""
    rows = [(r["path"][len(root) :] if r["path"].startswith(root) else r["path"], r) for r in rows]
    top: dict = {}
    for path, r in rows:
        *parents, name = [p for p in path.split("/") if p]
        here = top
        for p in parents:
            here = here.setdefault(p + "/", {})
        here[name] = r
    good = [r for _, r in rows if not r["parse_error"]]
    out = [f"{root or '.'} ({len(good)} files, {sum(r['lines'] for r in good)} lines total)"]

    def visit(nodes: dict, bars: str) -> None:
        for k, name in enumerate(entries := sorted(nodes, key=lambda x: (not x.endswith("/"), x))):
            own, last = nodes[name], k == len(entries) - 1
            inner = bars + ("    " if last else "│   ")
            label = name
            if not isinstance(own, dict):
                label += " (parse error)" if own["parse_error"] else f" ({own['lines']} lines, {own['sections'] or 'no'} sections)"
            out.append(f"{bars}{'└── ' if last else '├── '}{label}")
            if isinstance(own, dict):
                visit(own, inner)
                continue
            for j, heading in enumerate(own["headings"]):
                end = j == len(own["headings"]) - 1
                out.append(f"{inner}{'└── ' if end else '├── '}{heading}")
                if j < len(own["previews"]) and own["previews"][j]:
                    out.append(f"{inner}{'    ' if end else '│   '}     \"{own['previews'][j]}\"")

    visit(top, "")
    return "\n".join(out)


def table(rows: Iterable[Row]) -> str:
    """Any rows, one a line."""
    return "\n".join("\t".join("" if v is None else str(v) for v in r) for r in rows)


def result(kind: str, rows: Iterable[Row], title: str = "") -> str:
    """What a query gives, in the way of its kind."""
    rows = list(rows)
    n = lambda r: r if not isinstance(r, list) else ", ".join(map(str, r))
    if kind == "headings":
        return "\n".join([f"Found {len(rows)} headings:", *(f"{k}. [H{r['level']}] {r['text']}" for k, r in enumerate(rows, 1))])
    if kind == "sections":
        return "\n".join([f"Found {len(rows)} sections:", *(f"{k}. {r['title']} (lines {r['start_line']}-{r['end_line']})" for k, r in enumerate(rows, 1))])
    if kind == "code":
        return "\n".join([f"Found {len(rows)} code blocks:", *(f"\n{k}. [{r['language'] or 'plain'}] {r['lines']} lines\n---\n{r['content']}\n---" for k, r in enumerate(rows, 1))])
    if kind == "links":
        return "\n".join([f"Found {len(rows)} links:", *(f"{k}. {r['text']} -> {r['url']}" for k, r in enumerate(rows, 1))])
    if kind == "images":
        return "\n".join([f"Found {len(rows)} images:", *(f"{k}. {r['alt_text']}: {r['url']}" for k, r in enumerate(rows, 1))])
    if kind == "tables":
        return "\n".join([f"Found {len(rows)} tables:", *(f"\n{k}. Table with {len(r['headers'])} columns and {len(r['rows'])} rows\nHeaders: {n(r['headers'])}" for k, r in enumerate(rows, 1))])
    if kind == "values":
        return str(n(rows[0]["value"])) if len(rows) == 1 else "\n".join(f"{k}. {n(r['value'])}" for k, r in enumerate(rows, 1))
    if kind == "tree":
        return "\n".join(tree([r for r in rows if r["doc_id"] == doc], doc) for doc in dict.fromkeys(r["doc_id"] for r in rows))
    return search(rows, title) if kind == "search" else table(rows)


def document_info(d: Row) -> str:
    """A summary of one document, from a row of operators.structure.details."""
    out = [f"Document: {d['path']}", f"Format: {d['format']}", "=" * (len(d["path"]) + 10)]
    if d["metadata"]:
        out += ["", "Metadata:", *(f"  {k}: {v}" for k, v in (("Owner", d["owner"]), ("Tags", ", ".join(d["tags"] or [])), ("Priority", d["priority"])) if v)]
    if d["format"] in ("json", "jsonl", "yaml"):
        return "\n".join([*out, *_data_info(d)])
    counts = {"Headings": d["headings"], "Sections": [s for s in d["sections"] if s["indexed"]], "Code blocks": d["code_blocks"]}
    out += ["", "Structure:", *(f"  {k}: {len(v)}" for k, v in counts.items())]
    languages = Counter(b["language"] for b in d["code_blocks"] if b["language"])
    out += ["    Languages:"] * bool(languages) + [f"      - {k}: {v}" for k, v in sorted(languages.items())]
    out += [f"  {k}: {len(d[c])}" for k, c in (("Tables", "tables"), ("Links", "links"), ("Images", "images")) if d[c]]
    return "\n".join([*out, "", "Table of Contents:", *(f"{'  ' * (h['level'] - 1)}- {h['text']}" for h in d["headings"])])


def _data_info(d: Row) -> list[str]:
    """Of a data file: columns, rows and the first three, or the keys; and how its text begins."""
    out = ["", f"Title: {d['title']}"] if d["title"] else []
    keys = [h["text"] for h in d["headings"] if h["level"] == 1]
    for k, t in enumerate(d["tables"]):
        out += ["", "Data Type: Table (array of uniform objects)"] * (k == 0)
        out += [f"  Columns: {len(t['headers'])}", f"  Rows: {len(t['rows'])}", f"  Headers: {', '.join(t['headers'])}"]
        out += ["", "Sample (first 3 rows):", *(f"  {j}. {', '.join(r)}" for j, r in enumerate(t["rows"][:3], 1))] if t["rows"] else []
        out += [f"  ... and {len(t['rows']) - 3} more rows"] * (len(t["rows"]) > 3)
    if not d["tables"] and keys:
        out += ["", "Data Type: Object", f"  Top-level keys: {len(keys)}", "", "Keys:", *(f"  - {x}" for x in keys[:20])] + [f"  ... and {len(keys) - 20} more keys"] * (len(keys) > 20)
    if d["readable_text"]:
        lines = (d["readable_text"][:500] + "\n..." * (len(d["readable_text"]) > 500)).split("\n")
        out += ["", "Preview:", *(f"  {x}" for x in lines[:15])] + ["  ..."] * (len(lines) > 15)
    return out
