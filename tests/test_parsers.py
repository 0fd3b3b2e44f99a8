import json

import pytest

from docloom.lang.syntax import QueryError, parse
from docloom.sources import data, formats, html, markdown

DOC = """---
owner: alice
tags: [api, v2]
priority: high
---
# Title *one*

Intro with a [link](https://a.test "t"), ![pic](p.png) and `code`.

## Part A

```python
# not a heading
x = 1
```

| a | b |
| --- | :-: |
| 1 | 2 \\| 3 |
| 4 |

Setext
------

- [x] done
- [ ] open
  - inner
1. first

## Part A
    indented
> ### Quoted
####### seven
~~~~
```
unclosed
"""


def test_markdown_structure():
    s = markdown.parse(DOC)
    assert json.loads(s.metadata) == {"owner": "alice", "tags": ["api", "v2"], "priority": "high"}
    assert [(h["level"], h["text"], h["line"]) for h in s.headings] == [(1, "Title one", 6), (2, "Part A", 10), (2, "Setext", 22), (2, "Part A", 30), (3, "Quoted", 32)]
    assert [h["id"] for h in s.headings] == ["title-one", "part-a", "setext", "part-a-1", "quoted"]
    assert [(x["parent_id"], x["start_line"], x["end_line"], x["indexed"]) for x in s.sections] == [(None, 6, s.line_count, True), (0, 10, 21, False), (0, 22, 29, True), (0, 30, s.line_count, True), (3, 32, s.line_count, True)]
    assert [(c["language"], c["content"], c["section_id"]) for c in s.code_blocks] == [("python", "# not a heading\nx = 1\n", 1), ("", "```\nunclosed\n\n", 4)]
    assert s.links == [{"pos": 0, "text": "link", "url": "https://a.test"}] and s.images[0]["alt_text"] == "pic"
    assert s.tables == [{"pos": 0, "headers": ["a", "b"], "rows": [["1", "2 | 3"], ["4", ""]]}]
    assert [(i["text"], i["checked"], i["depth"]) for i in s.list_items] == [("done", True, 0), ("openinner", False, 0), ("inner", None, 1), ("first", None, 0)]
    assert [x["ordered"] for x in s.lists] == [False, False, True]


def test_markdown_inline_rules():
    s = markdown.parse("# A **b** [c *d*](u) <br> &amp; \\# e_f_g\n\n[**b**](x) [ref] <https://auto.test> [none]\n\n[ref]: http://r.test 'T'\n")
    assert s.headings[0]["text"] == "A b c d  & # e_f_g"
    assert [(x["text"], x["url"]) for x in s.links] == [("c ", "u"), ("", "x"), ("ref", "http://r.test")]
    assert markdown.parse("").headings == [] and markdown.parse("###").headings[0]["text"] == ""


def test_html_structure():
    page = """<html><head><title> T &amp; t </title></head><body><nav><a href="/n">nav</a></nav><main><h1 id="x"> One </h1><p>text<p>more <a href="/u">go</a><a href="#">no</a>
    <div class="ad-banner"><h2>ad</h2></div><h2>Two</h2><pre><code class="language-python">print(1)</code></pre><pre class="lang-ruby">r</pre>
    <table><thead><tr><th>a<th>b</thead><tr><td>1<td>2</table><ul><li>i<li><input type="checkbox" checked> j<ol><li>k</ol></ul><img src="p.png" alt="A"><img src="z" width="1"></main></body></html>"""
    s = html.parse(page, base_url="https://b.test/")
    assert s.title == "T & t" and [(h["level"], h["text"], h["id"]) for h in s.headings] == [(1, "One", "x"), (2, "Two", "")]
    assert [(x["text"], x["url"]) for x in s.links] == [("go", "https://b.test/u")] and len(s.images) == 1
    assert [(c["language"], c["content"]) for c in s.code_blocks] == [("python", "print(1)"), ("ruby", "r")]
    assert s.tables == [{"pos": 0, "headers": ["a", "b"], "rows": [["1", "2"]]}]
    assert [(i["checked"], i["depth"]) for i in s.list_items] == [(None, 0), (True, 0), (None, 1)]
    assert s.sections[1]["parent_id"] == 0 and s.sections[0]["start_line"] == 0
    assert "nav" not in s.readable_text and "ad" not in s.readable_text.split()
    assert len(html.parse(page, readability=False).links) == 2
    assert html.parse("<p>" * 3000 + "x").readable_text == "x"


def test_data_documents():
    s = data.parse_json('{"b": {"c": {"d": {"e": {"f": 1}}}}, "name": "N", "a": [1]}')
    assert s.title == "N" and [(h["text"], h["level"]) for h in s.headings] == [("a", 1), ("b", 1), ("c", 2), ("d", 3), ("e", 4), ("name", 1)]
    t = data.parse_jsonl('{"k": 1.5, "s": "x"}\n{broken\n\n{"k": 2, "s": null}')
    assert t.title == "Array (2 items)" and t.tables[0]["rows"] == [["1.50", "x"], ["2", "null"]]
    assert len(data.parse_json(json.dumps([1] * 150)).headings) == 100 and data.parse_json("3").title == "Value"
    assert data.format_value("é" * 40).endswith("...") and data.parse_yaml("a: 1").headings[0]["text"] == "a"
    with pytest.raises(ValueError):
        data.parse_json("{")


@pytest.mark.parametrize("path,content,kind", [("a.MD", b"", "markdown"), ("x.htm", b"", "html"), ("x", b"<!doctype", "html"), ("x", b"%PDF-1", "pdf"), ("x", b" [1]", "json"), ("x.ndjson", b"", "jsonl"), ("x", b"---\n", "yaml"), ("x.txt", b"t", "markdown")])
def test_formats(path, content, kind):
    assert formats.detect(path, content) == kind


@pytest.mark.parametrize("query", ["", "|", ".", ".headings |", ".headings | select()", ".headings | select(.level = 2)", ".a == 1", ".headings | filter(.level == 2 and .level == 3 == 1)", "'open", ".headings[:]"])
def test_queries_that_do_not_parse(query):
    with pytest.raises(QueryError):
        parse(query)
