import os
import zlib

import pytest

from docloom import render
from docloom.__main__ import answer
from docloom.lang.syntax import QueryError, parse
from docloom.operators import structure as S
from docloom.plans.builder import Builder
from docloom.plans.compiler import compile as compiled
from docloom.plans.compiler import query, query_one
from docloom.sources.reader import Registry, Structure, parse_documents, read_documents
from docloom.streaming.reader import stream_documents

TEXT = "---\nowner: alice\n---\n# A\n\nintro **here** now\n\n## B\n\n```go\nx\n```\n\n### C\n\n```\ny\n```\n\n## D\n\nneedle in D\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    (root / "sub").mkdir()
    (root / "a.md").write_text(TEXT)
    (root / "sub" / "b.md").write_text("# Z\n\nNEEDLE\n")
    (root / ".hidden.md").write_text("# H\n")
    (root / ".git").mkdir()
    (root / ".git" / "x.md").write_text("# G\n")
    (root / "c.json").write_text("{broken")
    return root


def values(df):
    return [r["value"] for r in df.collect()]


def test_directory(spark, folder):
    c = read_documents(spark, str(folder), glob="*.md")
    assert sorted(os.path.basename(r["path"]) for r in c.documents.select("path").collect()) == ["a.md", "b.md"]
    found = query(c, ".search('needle')", order=True).collect()
    assert [(r["section"], r["lines"]) for r in found] == [("A", "4-23"), ("D", "20-23"), ("Z", "1-4")]
    assert 'Found 3 matches for "needle"' in render.search(found, "needle")
    root = "file:" + str(folder)
    totals = {r["directory"]: (r["files"], r["sections"]) for r in S.directories(c, root).collect()}
    assert totals == {"": (2, 5), "sub": (1, 1)}
    assert [r["headings"] for r in S.files(c, "full").orderBy("path").collect()] == [["# A", "## B", "## D"], ["# Z"]]
    assert [r["previews"] for r in S.files(c, "full").orderBy("path").collect()] == [["intro here now", "x", "needle in D"], ["NEEDLE"]]
    shown = answer(spark, str(folder), ".tree('full')").split("\n")
    assert shown[0].endswith("(2 files, 27 lines total)") and shown[1] == "├── sub/" and shown[2] == "│   └── b.md (4 lines, 1 sections)"
    assert shown[3:5] == ["│       └── # Z", '│                "NEEDLE"'] and shown[5] == "└── a.md (23 lines, 4 sections)"
    assert "Found 3 matches" in answer(spark, str(folder), ".search('needle')") and "## B" not in answer(spark, str(folder))
    assert "Found 4 headings:\n1. [H1] A" in answer(spark, str(folder / "a.md"), ".headings") and "Owner: alice" in answer(spark, str(folder / "a.md"))
    broken = read_documents(spark, str(folder), glob="*.json").documents.first()
    assert broken["parse_error"] and broken["title"] == ""


def test_queries_on_one_document(spark):
    c = parse_documents(spark.createDataFrame([("1", "a.md", TEXT)], "doc_id string, path string, content string"))
    assert values(query_one(c, ".headings | .text")) == ["A", "B", "D", "C"]
    assert values(query_one(c, ".section('B') | .code | .content")) == ["x\n", "y\n"]
    assert values(query_one(c, ".section('B') | .code('go') | .language")) == ["go"]
    assert values(query_one(c, ".section('A') | .children | .title")) == ["B", "D"]
    assert values(query_one(c, ".headings | filter((.level == 2) and !contains('D')) | .text")) == ["B"]
    assert values(query_one(c, ".headings[1:3] | .text")) == ["B", "D"]
    assert values(query_one(c, ".owner")) == ["alice"] and values(query_one(c, ".links | length()")) == [0]
    for bad in (".section('no')", ".headings | .url", ".nothing", ".headings | filter(.text < 2)", ".headings | foo(1)", ".headings[9]"):
        with pytest.raises(QueryError):
            query_one(c, bad).collect()
    rows = S.tree(c).collect()
    assert [(r["depth"], r["type"], r["text"]) for r in sorted(rows, key=lambda r: r["seq"])] == [(0, "section", "A"), (1, "section", "B"), (2, "code", "go"), (2, "section", "C"), (3, "code", "plain"), (1, "section", "D")]
    assert "└── ## D (20-23)" in render.tree(rows)
    with pytest.raises(QueryError):
        Builder(c).links().as_headings()
    assert Builder(c).where_owner("bob").headings().result().count() == 0


def test_registry_and_nulls(spark):
    registry = Registry()
    registry.register("csv", lambda t: Structure(title=t.upper()))
    df = spark.createDataFrame([("1", "abc", 5), ("2", None, None)], "doc_id string, content string, links int")
    got = parse_documents(df, format="csv", registry=registry).documents.orderBy("doc_id").collect()
    assert [r["title"] for r in got] == ["ABC", ""]


def test_selector_arguments_are_applied_before_rows_are_made(spark):
    c = parse_documents(spark.createDataFrame([("1", "a.md", TEXT)], "doc_id string, path string, content string"), want=["headings"])
    plan = compiled(c, ".headings(2)").rows()._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode(filter(" in plan and "Window" not in plan


ONE_PARSE = [".headings(2) | .text", ".headings | length()", ".section('B') | .code('go') | .language", ".sections | .children | .title", ".sections | filter(.level == 2) | .text", ".tree", ".tree('full')", ".section('A') | .tree", ".search('needle')", ".headings[1:2] | .text", ".owner", ".links | length()"]


@pytest.mark.parametrize("text", ONE_PARSE)
def test_a_query_parses_once_and_shuffles_nothing(spark, text):
    c = parse_documents(spark.createDataFrame([("1", "a.md", TEXT)], "doc_id string, path string, content string"))
    plan = query(c, text)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Sort" not in plan


def test_builder_on_arrays_and_on_columns(spark):
    c = parse_documents(spark.createDataFrame([("1", "a.md", TEXT), ("1", "b.md", "# Z\n"), ("2", "c.md", None)], "doc_id string, path string, content string"))
    b = Builder(c).headings()
    assert sorted(values(b.skip(1).take(1).map("text").result())) == ["B"] and sorted(r["text"] for r in b.filter("level = 2").take(1).as_headings().collect()) == ["B"]
    assert sorted((r["doc_id"], r["value"]) for r in b.count().collect()) == [("1", 1), ("1", 4), ("2", 0)]
    assert sorted((r["doc_id"], r["value"]) for r in b.filter("level = 2").count().collect()) == [("1", 2), ("2", 0)]
    assert [r["text"] for r in Builder(c).where_owner("alice").headings(1).result().collect()] == ["A"] and b.where_owner("bob").count().count() == 0
    with pytest.raises(QueryError):
        b.filter("level = 2").links()


def test_documents_keep_columns_whatever_they_are_called(spark):
    df = spark.createDataFrame([(1, "# T\n", "web", "x", 3, "u")], "doc_id long, text string, source string, Title string, links int, other string")
    c = parse_documents(df, content="text")
    row = c.parsed.first()
    assert row["source"] == "# T\n" and row["other"] == "u" and row["title"] == "T"
    assert row["input"].asDict() == {"source": "web", "Title": "x", "links": 3}
    assert [r["text"] for r in c.headings.collect()] == ["T"]


@pytest.mark.parametrize("name,content", [("documents", "text"), ("pages", "html"), ("benchmark", "text"), ("conversations", "text"), ("events", "props"), ("nation", "n_name"), ("part", "p_type")])
def test_any_table_can_be_parsed(spark, name, content):
    df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(20)
    first = df.columns[0]
    c = parse_documents(df.withColumnRenamed(first, "doc_id"), content=content, want=["headings"])
    assert c.documents.count() == df.count()


def test_stream(spark, folder, tmp_path):
    c = stream_documents(spark, str(folder), glob="*.md")
    q = c.headings.writeStream.format("memory").queryName("stream_headings").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("stream_headings").count() == 5


def test_data_info(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("\n".join(f'{{"a": {k}, "b": "x"}}' for k in range(5)))
    (tmp_path / "o.json").write_text('{"k": 1, "l": {"m": 2}}')
    table, keys = (answer(spark, str(tmp_path / f)) for f in ("t.jsonl", "o.json"))
    assert "Columns: 2\n  Rows: 5\n  Headers: a, b" in table and "... and 2 more rows" in table
    assert "Data Type: Object\n  Top-level keys: 2" in keys and "  - k\n  - l" in keys


def test_extensions_add_to_what_a_parser_finds(spark):
    registry = Registry()
    registry.extend("markdown", lambda s, text: s.add_link("all", f"#{len(text)}"))
    c = parse_documents(spark.createDataFrame([("1", "abc")], "doc_id string, content string"), registry=registry)
    assert [(r["text"], r["url"]) for r in c.links.collect()] == [("all", "#3")]
    with pytest.raises(ValueError):
        registry.extend("nothing", print)


def test_visitors_and_walks_of_queries():
    node = parse(".headings | filter((.level == 2) and contains('x')) | .text[0:2]")

    class Names:
        def visit_selector(self, n):
            return [n.name]

        def visit(self, n):
            return [x for p in n.parts() for x in p.accept(self)]

    assert node.accept(Names()) == ["headings", "level", "text"]
    assert [type(n).__name__ for n in node.walk()].count("Selector") == 3
    with pytest.raises(QueryError):
        node.accept(object())


def pdf(content, flate=False):
    data = zlib.compress(content) if flate else content
    return b"%%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> /Contents 4 0 R >>\nendobj\n4 0 obj\n<< /Length %d %s>>\nstream\n%s\nendstream\nendobj\n5 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>\nendobj\n6 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>\nendobj\ntrailer << /Root 1 0 R >>\n%%%%EOF" % (len(data), b"/Filter /FlateDecode " if flate else b"", data)


PAPER = b"BT /F1 24 Tf 72 720 Td (A Paper \\(draft\\)) Tj ET BT /F1 12 Tf 72 690 Td 14 TL (Body text goes on here.) Tj T* [(Second) -300 (line) 20 ( of it)] TJ ET BT /F2 16 Tf 72 640 Td (Methods) Tj ET BT /F1 12 Tf 1 0 0 1 72 600 Tm (Name) Tj 1 0 0 1 200 600 Tm (Value) Tj 1 0 0 1 72 585 Tm (alpha) Tj 1 0 0 1 200 585 Tm <31> Tj ET"


@pytest.mark.parametrize("flate", [False, True])
def test_pdf_files(spark, tmp_path, flate):
    (tmp_path / "a.pdf").write_bytes(pdf(PAPER, flate))
    (tmp_path / "b.pdf").write_bytes(b"not a pdf")
    c = read_documents(spark, str(tmp_path), glob="*.pdf", min_ratio=1.2)
    a, b = c.documents.orderBy("path").collect()
    assert (a["format"], a["title"], b["title"], b["readable_text"]) == ("pdf", "A Paper (draft)", "", "")
    assert a["readable_text"].split("\n")[1:3] == ["Body text goes on here.", "Second line of it"]
    assert [(r["level"], r["text"]) for r in query(c, ".headings", order=True).collect()] == [(1, "A Paper (draft)"), (2, "Methods")]
    assert values(query(c, ".sections | .children | .title")) == ["Methods"]
    assert [list(r["headers"]) for r in c.tables.collect()] == [["Name", "Value"]]
    none = read_documents(spark, str(tmp_path), glob="*.pdf", infer=False, detect_tables=False)
    assert none.headings.count() == 0 and none.tables.count() == 0


def test_pdf_heading_rules_are_the_same_on_lines_and_on_columns(spark):
    from docloom.sources import pdf as P

    rows = [(t, r, b) for t in ["Methods", "a", "x" * 151, "One. Two", "3.14 159", "Copyright us", "Ann*", "Ends here."] for r in (0.9, 1.15, 1.25, 1.3, 1.5, 2.0) for b in (False, True)]
    df = spark.createDataFrame(rows, "t string, r double, b boolean")
    got = df.select("t", "r", "b", P.likely_heading(df["t"]).alias("l"), P.heading_level(df["r"], df["b"]).alias("n")).collect()
    assert all(r["l"] == P.is_heading(r["t"]) and r["n"] == P.level_of(r["r"], r["b"]) for r in got)


MAIN = [("<div class='Page-Content'><h1>In</h1></div>", ["In"]), ("<div id='post'><h1>First</h1></div><div id='content'><h1>Second</h1></div>", ["First"]), ("<div ID='CONTENT'><h1>In</h1></div>", ["In"]), ("<div id='contents'><h1>In</h1></div>", ["Outside", "In"]), ("<div class='x'><h1>In</h1></div>", ["Outside", "In"])]


@pytest.mark.parametrize("inner,want", MAIN)
def test_main_part_of_a_page(inner, want):
    from docloom.sources import html

    found = html.parse(f"<html><body><h1>Outside</h1>{inner}</body></html>").headings
    assert [h["text"] for h in found] == want


def test_skip_brings_no_more_than_the_first_rows_together(spark):
    from docloom.operators import generic as G

    rows = [(k % 5, k // 10, "x") for k in range(40)] * 2
    df = spark.createDataFrame(rows, "a int, b int, c string").repartition(4)
    for n in (-1, 0, 1, 7, 79, 80, 99):
        got = [tuple(r) for r in G.skip(df, n, "a", "b").collect()]
        assert got == sorted(rows)[max(0, n) :]
    plan = G.skip(df, 7, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CollectLimit" not in plan
    maps = df.selectExpr("a", "map(a, b) AS m")
    assert G.skip(maps, 7, "a").count() == 73
