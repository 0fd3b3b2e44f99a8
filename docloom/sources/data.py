"""JSON, JSON Lines and YAML as documents: keys are headings, uniform arrays are tables."""

from __future__ import annotations

import json

from docloom.sources.structure import Structure

MOST_ITEMS, MOST_COLUMNS, DEEPEST, READABLE_BYTES = 100, 20, 4, 50_000


def cut_bytes(text: str, n: int) -> str:
    """The first n bytes, without a torn character."""
    return text.encode()[:n].decode(errors="ignore")


def format_value(v) -> str:
    """A table cell."""
    if isinstance(v, str):
        return cut_bytes(v, 47) + "..." if len(v.encode()) > 50 else v
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return str(int(v)) if v == v and abs(v) != float("inf") and v == int(v) else f"{v:.2f}"
    if isinstance(v, dict):
        return f"{{{len(v)} keys}}"
    return f"[{len(v)} items]" if isinstance(v, list) else str(v)


def as_table(items: list) -> tuple[list[str], list[list[str]]] | None:
    """Headers and rows if all items are objects of the same 1 to 20 keys."""
    if not items or not isinstance(items[0], dict):
        return None
    keys = sorted(map(str, items[0]))
    if not 1 <= len(keys) <= MOST_COLUMNS or any(not isinstance(x, dict) or sorted(map(str, x)) != keys for x in items):
        return None
    named = [{str(k): v for k, v in x.items()} for x in items]
    return keys, [[format_value(x[k]) for k in keys] for x in named]


def title_of(obj: dict) -> str:
    for key in ("title", "name", "id", "type", "role"):
        if isinstance(v := obj.get(key), str) and len(v.encode()) < 100:
            return v
    return f"Object ({len(obj)} keys)"


def _keys(out: Structure, obj: dict, level: int, parent: int | None, headings: bool, sections: bool) -> None:
    for key in sorted(map(str, obj)):
        if headings:
            out.add_heading(level, key)
        section = out.add_section(key, level, parent, indexed=parent is None) if sections else None
        value = obj.get(key)
        if isinstance(value, dict) and level < DEEPEST:
            _keys(out, value, level + 1, section, headings, sections)


#: Headings and sections of objects by their keys; those of many documents are alike.
_SEEN: dict[tuple, tuple[list[dict], list[dict]]] = {}
_MOST_SEEN, _MOST_KEYS = 1000, 200


def _shape(obj: dict, level: int, left: list[int]) -> tuple:
    """The keys of an object and of the objects in it; an error where there are too many, or such as are no strings."""
    left[0] -= len(obj)
    if left[0] < 0:
        raise ValueError("too many keys")
    out = []
    for key, value in obj.items():
        if type(key) is not str:
            raise ValueError("no string")
        out.append(key)
        if level < DEEPEST and isinstance(value, dict):
            out.append(_shape(value, level + 1, left))
    return tuple(out)


def build(data, line_count: int, want: frozenset[str] | None = None, readable: bool = True) -> Structure:
    """The document of a parsed value; only the element tables in want, if given, and its text only if readable.

    With want, documents of the same keys share their headings and sections, which must not be changed then.
    """
    out = Structure(line_count=line_count)
    headings, sections = (want is None or x in want for x in ("headings", "sections"))
    shape = None
    if isinstance(data, dict):
        out.title = title_of(data)
        if want is not None:
            try:
                shape = headings, sections, _shape(data, 1, [_MOST_KEYS])
            except ValueError:
                pass
    if shape is not None and shape in _SEEN:
        out.headings, out.sections = _SEEN[shape]
    elif isinstance(data, dict):
        _keys(out, data, 1, None, headings, sections)
    elif isinstance(data, list):
        if data:
            out.title = f"Array ({len(data)} items)"
            if table := as_table(data):
                out.add_table(*table)
            else:
                for k, item in enumerate(data[:MOST_ITEMS]):
                    if headings:
                        out.add_heading(1, f"Item {k + 1}")
                    section = out.add_section(f"Item {k + 1}", 1, None) if sections else None
                    if isinstance(item, dict):
                        _keys(out, item, 2, section, headings, sections)
    else:
        out.title = "Value"
    last = {s["title"]: s["section_id"] for s in out.sections if s["indexed"]}
    for s in out.sections:
        s["indexed"] = last.get(s["title"]) == s["section_id"]
    if shape is not None and shape not in _SEEN:
        if len(_SEEN) >= _MOST_SEEN:
            _SEEN.clear()
        _SEEN[shape] = out.headings, out.sections
    if not readable:
        return out
    text = json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False, default=str)
    for a, b in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        text = text.replace(a, b)
    out.readable_text = text if len(text.encode()) <= READABLE_BYTES else cut_bytes(text, READABLE_BYTES) + "\n... (truncated)"
    return out


def parse_json(source: str, **asked) -> Structure:
    return build(json.loads(source), source.count("\n") + 1, **asked)


def parse_jsonl(source: str, max_lines: int | None = None, **asked) -> Structure:
    """An array of the lines that are JSON; others, and blank ones, are left out and don't count toward max_lines."""
    items = []
    for line in source.split("\n"):
        if max_lines is not None and len(items) >= max_lines:
            break
        try:
            items.append(json.loads(line))
        except ValueError:
            continue
    return build(items, source.count("\n") + 1, **asked)


def parse_yaml(source: str, **asked) -> Structure:
    import yaml

    return build(yaml.safe_load(source), source.count("\n") + 1, **asked)
