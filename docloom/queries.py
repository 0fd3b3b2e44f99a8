"""One query for each operator, with its SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import corpora as C
from docloom.functions import text as X
from docloom.operators import generic as G
from docloom.operators import predicates as P
from docloom.operators import structure as S
from docloom.plans.builder import Builder
from docloom.plans.compiler import query
from docloom.sources import formats, pdf
from docloom.sources.reader import parse_documents

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Lines of the Markdown texts of corpora.region_markdown.
_BASE = """
WITH c AS (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1),
 n AS (SELECT CAST(r_regionkey AS VARCHAR) AS doc_id, r_regionkey, r_name, n_nationkey, n_name, coalesce(c, 0) AS c,
   row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS k,
   CAST(10 + coalesce(sum(14 + 2 * coalesce(c, 0)) OVER (PARTITION BY r_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line
  FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN c ON s_nationkey = n_nationkey),
 d AS (SELECT CAST(r_regionkey AS VARCHAR) AS doc_id, r_regionkey, r_name, CAST(9 + coalesce(sum(14 + 2 * coalesce(n.c, 0)), 0) AS BIGINT) AS lines, count(n.n_nationkey) AS nations
  FROM region LEFT JOIN n USING (r_regionkey, r_name) GROUP BY 1, 2, 3),
 h AS (SELECT doc_id, CAST(0 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS level, r_name AS text, CAST(6 AS BIGINT) AS line, lines AS end_line FROM d
  UNION ALL SELECT n.doc_id, k, 2, n_name, line, line + 13 + 2 * c FROM n),
 code AS (SELECT doc_id, k - 1 AS pos, k AS section_id, ['python', 'go', 'bash'][n_nationkey % 3 + 1] AS language, 'print(' || n_nationkey || ')' || chr(10) AS content, n_name FROM n),
 s AS (SELECT n.doc_id, s_name, s_suppkey, n_nationkey, n_name, k, row_number() OVER (PARTITION BY n.doc_id ORDER BY n_nationkey, s_suppkey) - 1 AS pos FROM supplier JOIN n ON s_nationkey = n_nationkey)
"""


def wide(df: DataFrame) -> DataFrame:
    """Whole numbers as 64 bits, as the SQL has them."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def _add(name: str, sql: str | None = None):
    def to(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return wide(f(spark, sf_dir))

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return f

    return to


def _md(name: str, want: tuple[str, ...], text: str, sql: str | None = None, variables: dict | None = None) -> None:
    """A query in the pipe language over the Markdown texts."""
    _add(name, _BASE + sql if sql else None)(lambda s, d: query(C.markdown(s, d, *want), text, variables))


_UNESCAPED = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_TITLE = "trim(" + _UNESCAPED.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')") + ", ' \\n\\t')"
_H1 = "trim(" + _UNESCAPED.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')") + ", ' ' || chr(10) || chr(9))"
_TITLE = _TITLE.replace("' \\n\\t'", "' ' || chr(10) || chr(9)")

# Web pages
_add("html_title", f"SELECT CAST(page_id AS VARCHAR) AS doc_id, {_TITLE} AS title FROM pages")(lambda s, d: C.pages(s, d, "headings").documents.select("doc_id", "title"))
_add("html_h1", f"SELECT CAST(page_id AS VARCHAR) AS doc_id, {_H1} AS value FROM pages WHERE {_H1} <> ''")(lambda s, d: query(C.pages(s, d, "headings"), ".headings(1) | .text"))
_add("html_headings", f"SELECT CAST(page_id AS VARCHAR) AS doc_id, CAST(1 AS BIGINT) AS n FROM pages WHERE {_H1} <> ''")(lambda s, d: C.pages(s, d, "headings").headings.groupBy("doc_id").agg(F.count("*").alias("n")))
_add("html_links_none", "SELECT CAST(page_id AS VARCHAR) AS doc_id, CAST(0 AS BIGINT) AS value FROM pages")(lambda s, d: query(C.pages(s, d, "links"), ".links | length()"))
_add("html_lists_none", "SELECT CAST(page_id AS VARCHAR) AS doc_id, CAST(0 AS BIGINT) AS value FROM pages")(lambda s, d: query(C.pages(s, d, "lists"), ".lists | .length"))
_add("html_all_lists", f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '<nav><ul>(.*?)</ul></nav>', 1, 's'), '<a href="[^"]*">(.*?)</a>', 1)) AS t, generate_subscripts(regexp_extract_all(regexp_extract(html, '<nav><ul>(.*?)</ul></nav>', 1, 's'), '<a href="[^"]*">(.*?)</a>', 1), 1) - 1 AS k FROM pages)
SELECT CAST(page_id AS VARCHAR) AS doc_id, CAST(k AS BIGINT) AS item_id, {_UNESCAPED.format('t')} AS text FROM a""")(lambda s, d: C.pages(s, d, "lists", "list_items", readability=False).list_items.filter("list_pos = 0").select("doc_id", "item_id", "text"))
_add("html_readable", f"""WITH t AS (SELECT page_id, regexp_replace({_UNESCAPED.format("regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[^>]*>', '', 'g')")}, '\\s+', '', 'g') AS text FROM pages WHERE html NOT LIKE '%&#%' OR true)
SELECT CAST(page_id AS VARCHAR) AS doc_id, text FROM t""")(lambda s, d: C.pages(s, d, "headings").documents.select("doc_id", F.regexp_replace("readable_text", "\\s+", "").alias("text")))
_add("html_sections", f"SELECT CAST(page_id AS VARCHAR) AS doc_id, {_H1} AS title, CAST(0 AS BIGINT) AS start_line, '' AS text FROM pages WHERE {_H1} <> ''")(lambda s, d: C.pages(s, d, "sections").sections().select("doc_id", "title", "start_line", "text"))
_add("detect_format", "SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.(html|htm|xhtml)$') THEN 'html' WHEN regexp_matches(lower(url), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(url), '\\.json$') THEN 'json' WHEN regexp_matches(lower(url), '\\.(yaml|yml)$') THEN 'yaml' WHEN starts_with(ltrim(html), '<!') OR starts_with(ltrim(html), '<html') OR starts_with(ltrim(html), '<HTML') THEN 'html' ELSE 'markdown' END AS format FROM pages")(lambda s, d: C.table(s, d, "pages").select("page_id", formats.detect_column(F.col("url"), F.col("html")).alias("format")))

# HTML made of the tables: what surrounds the main part, and all kinds of elements in it
_ITEMS = "SELECT n_regionkey, r_name, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation JOIN region ON n_regionkey = r_regionkey"
_add("html_main_part", f"SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, min(r_name) AS value FROM ({_ITEMS}) GROUP BY 1")(lambda s, d: query(C.region_html(s, d, "headings"), ".headings(1) | .text"))
_add("html_links", f"SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, k AS pos, n_name AS text, 'https://example.test/n/' || n_nationkey AS url FROM ({_ITEMS})")(lambda s, d: C.region_html(s, d, "links", base_url="https://example.test/all/").links)
_add("html_images", f"SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, k AS pos, n_name AS alt_text, 'https://example.test/all/flags/' || n_nationkey || '.png' AS url, 'flag' AS title FROM ({_ITEMS})")(lambda s, d: C.region_html(s, d, "images", base_url="https://example.test/all/").images)
_add("html_table_rows", f"SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, 'nation,key' AS headers, n_name AS nation, CAST(n_nationkey AS VARCHAR) AS key FROM ({_ITEMS})")(lambda s, d: query(C.region_html(s, d, "tables"), ".tables").select("doc_id", F.array_join("headers", ",").alias("headers"), F.explode("rows").alias("r")).select("doc_id", "headers", F.col("r")[0].alias("nation"), F.col("r")[1].alias("key")))
_add("html_lists_ordered", "SELECT CAST(r_regionkey AS VARCHAR) AS doc_id, true AS ordered FROM region")(lambda s, d: query(C.region_html(s, d, "lists"), ".lists(true)").select("doc_id", "ordered"))
_add("html_list_items", f"SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, k AS item_id, n_name AS text FROM ({_ITEMS})")(lambda s, d: C.region_html(s, d, "lists", "list_items").list_items.select("doc_id", "item_id", "text"))
_add("html_code", f"SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, CASE n_nationkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'rust' END AS language, 'f(' || n_nationkey || ')' AS content FROM ({_ITEMS})")(lambda s, d: query(C.region_html(s, d, "code_blocks"), ".code").select("doc_id", "language", F.trim(F.regexp_replace("content", "\n", "")).alias("content")))
_add("html_section_hierarchy", f"SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, n_name AS title, r_name AS parent FROM ({_ITEMS})")(lambda s, d: (lambda t: t.select("doc_id", F.explode(F.filter("sections", lambda x: x["parent_id"].isNotNull())).alias("x"), "sections").select("doc_id", F.col("x.title").alias("title"), F.get("sections", F.col("x.parent_id"))["title"].alias("parent")))(C.region_html(s, d, "sections").parsed))
_add("html_skipped", f"SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, CAST(2 + count(*) AS BIGINT) AS value FROM ({_ITEMS}) GROUP BY 1")(lambda s, d: query(C.region_html(s, d, "links", readability=False), ".links | length()"))

# Markdown: elements
_add("md_headings", _BASE + "SELECT doc_id, pos, level, text, line FROM h")(lambda s, d: C.markdown(s, d, "headings").headings.drop("id"))
_md("md_headings_level", ("headings",), ".headings(2) | .text", "SELECT doc_id, text AS value FROM h WHERE level = 2")
_md("md_heading_levels_in_order", ("headings",), ".headings(2, 1) | .level", "SELECT doc_id, level AS value FROM h")
_add("md_heading_by_text", _BASE + "SELECT doc_id, max(pos) AS pos FROM h WHERE text = 'NATION_3' OR text LIKE '%_1' GROUP BY doc_id, text")(lambda s, d: C.markdown(s, d, "headings").headings.filter("text = 'NATION_3' OR text LIKE '%_1'").groupBy("doc_id", "text").agg(F.max("pos").alias("pos")).select("doc_id", "pos"))
_add("md_sections", _BASE + "SELECT doc_id, text AS title, level, line AS start_line, end_line FROM h")(lambda s, d: C.markdown(s, d, "sections").sections(text=False).filter("indexed").select("doc_id", "title", "level", "start_line", "end_line"))
_add("md_section_children", _BASE + "SELECT doc_id, text AS title, CAST(0 AS BIGINT) AS parent_id FROM h WHERE level = 2")(lambda s, d: C.markdown(s, d, "sections").sections(text=False).filter("parent_id IS NOT NULL").select("doc_id", "title", "parent_id"))
_add("md_section_span_native", _BASE + "SELECT doc_id, text, end_line, CASE WHEN level = 2 THEN CAST(0 AS BIGINT) END AS parent_pos FROM h")(lambda s, d: _native(C.markdown(s, d, "headings")))
_add("md_toc", _BASE + "SELECT doc_id, r_name AS title FROM d")(lambda s, d: C.markdown(s, d, "sections").sections(text=False).filter("indexed AND parent_id IS NULL").select("doc_id", "title"))
_add("md_section_text", _BASE + "SELECT doc_id, text AS title, end_line - line + 1 AS n FROM h")(lambda s, d: C.markdown(s, d, "sections").sections().select("doc_id", "title", X.lines(F.col("text")).alias("n")))
_md("md_children", ("sections", "headings"), ".sections | .children | .title", "SELECT doc_id, text AS value FROM h WHERE level = 2")
_md("md_table_headers", ("tables",), ".tables | .headers", "SELECT doc_id, ['supplier', 'key'] AS value FROM n")
_md("md_table_row_lists", ("tables",), ".tables | .rows | length()", "SELECT doc_id, c AS value FROM n")
_md("md_lists_unordered", ("lists",), ".lists(false) | .ordered", "SELECT doc_id, false AS value FROM n WHERE c > 0")
_md("md_section_by_title", ("sections",), ".section('NATION_3') | .start", "SELECT doc_id, line AS value FROM n WHERE n_name = 'NATION_3'")
_md("md_section_subtree_code", ("sections", "code_blocks"), ".sections | filter(.level == 1) | .code('go') | .content", "SELECT doc_id, content AS value FROM code WHERE language = 'go'")
_md("md_code", ("code_blocks",), ".code", "SELECT doc_id, pos, section_id, language, content, CAST(1 AS BIGINT) AS lines FROM code")
_md("md_code_languages", ("code_blocks",), ".code('go', 'python') | .content", "SELECT doc_id, content AS value FROM code WHERE language IN ('go', 'python')")
_add("md_section_code", _BASE + "SELECT doc_id, content FROM code")(lambda s, d: S.section_code(C.markdown(s, d, "sections", "code_blocks"), lambda x: x["parent_id"].isNull()).select("doc_id", "content"))
_md("md_links", ("links",), ".links", "SELECT doc_id, pos, s_name AS text, 'https://example.test/s/' || s_suppkey AS url FROM s")
_md("md_images", ("images",), ".images", "SELECT doc_id, k - 1 AS pos, n_name AS alt_text, 'flags/' || n_nationkey || '.png' AS url, 'flag ' || n_nationkey AS title FROM n")
_add("md_tables", _BASE + "SELECT n.doc_id, k - 1 AS pos, c AS n_rows, 'supplier,key' AS header FROM n")(lambda s, d: C.markdown(s, d, "tables").tables.select("doc_id", "pos", F.size("rows").alias("n_rows"), F.array_join("headers", ",").alias("header")))
_add("md_table_rows", _BASE + "SELECT doc_id, s_name AS supplier, CAST(s_suppkey AS VARCHAR) AS key FROM s")(lambda s, d: C.markdown(s, d, "tables").tables.select("doc_id", F.explode("rows").alias("r")).select("doc_id", F.col("r")[0].alias("supplier"), F.col("r")[1].alias("key")))
_add("md_lists", _BASE + "SELECT doc_id, count(*) AS n, false AS ordered FROM n WHERE c > 0 GROUP BY doc_id")(lambda s, d: C.markdown(s, d, "lists").lists.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("ordered").alias("ordered")))
_add("md_list_items", _BASE + "SELECT doc_id, pos AS item_id, s_name AS text FROM s")(lambda s, d: C.markdown(s, d, "list_items").list_items.select("doc_id", "item_id", "text"))
_add("md_title", _BASE + "SELECT doc_id, r_name AS title, lines AS line_count FROM d")(lambda s, d: C.markdown(s, d, "headings").documents.select("doc_id", "title", "line_count"))
_md("md_owner", ("headings",), ".owner", "SELECT doc_id, r_name AS value FROM d")
_md("md_priority", ("headings",), ".priority", "SELECT doc_id, CASE WHEN r_regionkey % 2 = 0 THEN 'high' ELSE 'low' END AS value FROM d")
_add("md_tags", _BASE + "SELECT doc_id, unnest(['geo', r_name]) AS tag FROM d")(lambda s, d: query(C.markdown(s, d, "headings"), ".tags").select("doc_id", F.explode("value").alias("tag")))
_add("md_metadata", _BASE + "SELECT doc_id, r_name AS owner, 'geo,' || r_name AS tags, CASE WHEN r_regionkey % 2 = 0 THEN 'high' ELSE 'low' END AS priority FROM d")(lambda s, d: query(C.markdown(s, d, "headings"), ".metadata").select("doc_id", F.get_json_object("value", "$.owner").alias("owner"), F.concat_ws(",", F.from_json(F.get_json_object("value", "$.tags"), "array<string>")).alias("tags"), F.get_json_object("value", "$.priority").alias("priority")))
_add("where_owner", _BASE + "SELECT doc_id, text FROM h WHERE doc_id IN (SELECT doc_id FROM d WHERE r_name = (SELECT min(r_name) FROM region))")(lambda s, d: C.markdown(s, d, "headings").where_owner(C.table(s, d, "region").agg(F.min("r_name")).first()[0]).headings.select("doc_id", "text"))
_add("where_tag", _BASE + "SELECT doc_id, r_name AS title FROM d")(lambda s, d: C.markdown(s, d, "headings").where_tag("geo").documents.select("doc_id", "title"))
_add("where_priority", _BASE + "SELECT doc_id, text FROM h WHERE CAST(doc_id AS INT) % 2 = 0")(lambda s, d: Builder(C.markdown(s, d, "headings")).where_priority("high").headings().result().select("doc_id", "text"))


def _native(m) -> DataFrame:
    counts = m.parsed.select("doc_id", "line_count")
    return S.hierarchy(m.headings.join(counts, "doc_id"), F.col("line_count")).select("doc_id", "text", "end_line", "parent_pos")


# The pipe language
_H = ("headings",)
_md("pipe_filter_compare", _H, ".headings | select(.level <= 1) | .text", "SELECT doc_id, text AS value FROM h WHERE level <= 1")
_md("pipe_filter_not_equal", _H, ".headings | filter(.level != 2) | .text", "SELECT doc_id, text AS value FROM h WHERE level <> 2")
_md("pipe_filter_and", _H, ".headings | filter((.level == 2) and contains('A')) | .text", "SELECT doc_id, text AS value FROM h WHERE level = 2 AND contains(text, 'A')")
_md("pipe_filter_or", _H, ".headings | filter((.level == 1) or endswith('A')) | .text", "SELECT doc_id, text AS value FROM h WHERE level = 1 OR suffix(text, 'A')")
_md("pipe_map_property", _H, ".headings | map(.level)", "SELECT doc_id, level AS value FROM h")
_md("pipe_map_test", _H, ".headings | map(startswith('A'))", "SELECT doc_id, starts_with(text, 'A') AS value FROM h")
_md("pipe_map_length", _H, ".headings | map(length())", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS value FROM h")
_md("pipe_index", _H, ".headings(2)[1] | .text", "SELECT doc_id, text AS value FROM h WHERE pos = 2")
_md("pipe_slice", _H, ".headings(2)[1:3] | .text", "SELECT doc_id, text AS value FROM h WHERE pos IN (2, 3)")
_md("pipe_string_slice", _H, ".headings | .text | .text[0:2]", "SELECT doc_id, substr(text, 1, 2) AS value FROM h")
_md("pipe_length", _H, ".headings | length()", "SELECT doc_id, nations + 1 AS value FROM d")
_md("pipe_contains", _H, ".headings | select(contains('I')) | .text", "SELECT doc_id, text AS value FROM h WHERE contains(text, 'I')")
_md("pipe_startswith", _H, ".headings | select(startswith('A')) | .text", "SELECT doc_id, text AS value FROM h WHERE starts_with(text, 'A')")
_md("pipe_endswith", _H, ".headings | select(endswith('A')) | .text", "SELECT doc_id, text AS value FROM h WHERE suffix(text, 'A')")
_md("pipe_not", _H, ".headings | filter(!(.level == 2)) | .text", "SELECT doc_id, text AS value FROM h WHERE level <> 2")
_md("pipe_negative", _H, ".headings | filter(-.level == -2) | .text", "SELECT doc_id, text AS value FROM h WHERE level = 2")
_md("pipe_truth", _H, ".headings | filter(.text and .level) | .text", "SELECT doc_id, text AS value FROM h")
_md("pipe_grouping", _H, ".headings | filter((.level == 1) or ((.level == 2) and endswith('_1'))) | .text", "SELECT doc_id, text AS value FROM h WHERE level = 1 OR text LIKE '%\\_1' ESCAPE '\\'")
_md("pipe_variable", _H, ".headings | filter(.level == wanted) | .text", "SELECT doc_id, text AS value FROM h WHERE level = 1", {"wanted": 1})
_md("pipe_section_code", ("sections", "code_blocks"), ".section('NATION_3') | .code('python', 'go', 'bash') | .content", "SELECT doc_id, content AS value FROM code WHERE n_name = 'NATION_3'")
_md("pipe_section_heading", ("sections",), ".sections | .heading | .text", "SELECT doc_id, text AS value FROM h")
_md("pipe_section_lines", ("sections",), ".sections | filter(.start > 6) | .end", "SELECT doc_id, end_line AS value FROM h WHERE level = 2")
_md("pipe_code_language", ("code_blocks",), ".code | filter(.language == 'go') | .lines", "SELECT doc_id, CAST(1 AS BIGINT) AS value FROM code WHERE language = 'go'")
_md("pipe_links_filter", ("links",), ".links | filter(contains(.url, '1')) | .url", "SELECT doc_id, 'https://example.test/s/' || s_suppkey AS value FROM s WHERE contains('https://example.test/s/' || s_suppkey, '1')")
_md("pipe_image_alt", ("images",), ".images | .alt", "SELECT doc_id, n_name AS value FROM n")

# Search and outlines
_SNIPPET = "trim(regexp_replace(substr(text, greatest(p - 60, 1), least(p + 62, length(text)) - greatest(p - 60, 1) + 1), '\\s+', ' ', 'g'), ' ')"
_add("search_documents", f"WITH t AS (SELECT doc_id, text, strpos(lower(text), 'the') AS p FROM documents WHERE contains(lower(text), 'the')) SELECT doc_id, CASE WHEN p > 61 THEN '...' ELSE '' END || {_SNIPPET} || CASE WHEN p + 62 < length(text) THEN '...' ELSE '' END AS match FROM t")(lambda s, d: C.table(s, d, "documents").filter(F.contains(F.lower("text"), F.lit("the"))).select("doc_id", X.snippet(F.col("text"), "the").alias("match")))
_add("search_sections", _BASE + "SELECT doc_id, text AS section, level, line || '-' || end_line AS lines FROM h")(lambda s, d: query(C.markdown(s, d, "sections"), ".search('PRINT(')").select("doc_id", "section", "level", "lines"))
_add("preview", _BASE + "SELECT doc_id, r_name AS title, 'Intro of ' || r_name || '.' AS preview FROM d UNION ALL SELECT doc_id, n_name, 'Nation ' || n_name || ' has key ' || n_nationkey || '.' FROM n")(lambda s, d: C.markdown(s, d, "sections").sections().select("doc_id", "title", X.preview(F.col("text")).alias("preview")))
_TREE = "SELECT doc_id, CASE WHEN level = 1 THEN CAST(0 AS BIGINT) ELSE {} END AS seq, level - 1 AS depth, 'section' AS type, text, '' AS meta FROM h"
_add("tree_compact", _BASE + _TREE.format("pos"))(lambda s, d: S.tree(C.markdown(s, d, "sections"), "compact").select("doc_id", "seq", "depth", "type", "text", "meta"))
_add("tree_default", _BASE + _TREE.format("2 * pos - 1") + " UNION ALL SELECT doc_id, 2 * section_id, CAST(2 AS BIGINT), 'code', language, '1 block' FROM code")(lambda s, d: S.tree(C.markdown(s, d, "sections", "code_blocks")).select("doc_id", "seq", "depth", "type", "text", "meta"))
_add("tree_preview", _BASE + "SELECT doc_id, r_name AS text, 'Intro of ' || r_name || '.' AS preview FROM d UNION ALL SELECT doc_id, n_name, 'Nation ' || n_name || ' has key ' || n_nationkey || '.' FROM n")(lambda s, d: query(C.markdown(s, d, "sections"), ".tree('preview')").select("doc_id", "text", "preview"))
_add("tree_full", _BASE + "SELECT doc_id, text, line AS start_line, end_line FROM h")(lambda s, d: query(C.markdown(s, d, "sections"), ".tree('full')").select("doc_id", "text", "start_line", "end_line"))
_add("tree_section", _BASE + "SELECT doc_id, n_name AS text, 'section' AS type FROM n WHERE n_name = 'NATION_3' UNION ALL SELECT doc_id, language, 'code' FROM code WHERE n_name = 'NATION_3'")(lambda s, d: query(C.markdown(s, d, "sections", "code_blocks"), ".section('NATION_3') | .tree").select("doc_id", "text", "type"))
_add("dir_files", _BASE + "SELECT 'docs/' || CASE WHEN r_regionkey < 2 THEN 'a/' ELSE 'b/' END || doc_id || '.md' AS path, lines, nations + 1 AS sections FROM d")(lambda s, d: S.files(C.markdown(s, d, "sections")).select("path", "lines", "sections"))
_add("dir_previews", _BASE + "SELECT doc_id, 'Intro of ' || r_name || '.' AS preview FROM d UNION ALL SELECT doc_id, 'Nation ' || n_name || ' has key ' || n_nationkey || '.' FROM n")(lambda s, d: S.files(C.markdown(s, d, "sections"), "full").select(F.regexp_extract("path", r"(\d+)\.md$", 1).alias("doc_id"), F.explode("previews").alias("preview")))
_add("search_directory", _BASE + "SELECT 'docs/' || CASE WHEN r_regionkey < 2 THEN 'a/' ELSE 'b/' END || doc_id || '.md' AS path, n_name AS section FROM (SELECT *, r_name AS r FROM n) WHERE n_name = 'NATION_3' UNION ALL SELECT 'docs/' || CASE WHEN r_regionkey < 2 THEN 'a/' ELSE 'b/' END || doc_id || '.md', r_name FROM n WHERE n_name = 'NATION_3'")(lambda s, d: (lambda m: S.search(m, "nation nation_3 has").join(m.documents.select("doc_id", "path"), "doc_id").select("path", "section"))(C.markdown(s, d, "sections", "headings")))
_add("summary_languages", _BASE + "SELECT doc_id, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM code GROUP BY doc_id")(lambda s, d: S.summary(C.markdown(s, d)).select("doc_id", F.array_join("languages", ",").alias("languages")))
_add("dir_headings", _BASE + "SELECT doc_id, '# ' || r_name AS heading FROM d UNION ALL SELECT doc_id, '## ' || n_name FROM n")(lambda s, d: S.files(C.markdown(s, d, "sections"), "preview").select(F.regexp_extract("path", r"(\d+)\.md$", 1).alias("doc_id"), F.explode("headings").alias("heading")))
_add("dir_totals", _BASE + "SELECT directory, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(nations + 1) AS BIGINT) AS sections FROM (SELECT unnest(['', 'docs', 'docs/' || CASE WHEN r_regionkey < 2 THEN 'a' ELSE 'b' END]) AS directory, lines, nations FROM d) GROUP BY 1")(lambda s, d: S.directories(C.markdown(s, d, "sections")))
_add("summary", _BASE + "SELECT doc_id, lines AS line_count, nations AS n_code_blocks, nations AS n_images, nations + 1 AS n_sections FROM d")(lambda s, d: S.summary(C.markdown(s, d)).select("doc_id", "line_count", "n_code_blocks", "n_images", "n_sections"))

# JSON, JSON Lines, YAML
_ORDER = "FROM orders JOIN customer ON o_custkey = c_custkey"
_add("json_headings", f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, unnest(['customer', 'market', 'segment', 'name', 'key', 'title']) AS text, unnest([1, 2, 3, 2, 1, 1])::BIGINT AS level {_ORDER}")(lambda s, d: C.order_json(s, d, "headings").headings.select("doc_id", "text", "level"))
_add("json_title", f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderpriority AS title {_ORDER}")(lambda s, d: C.order_json(s, d, "headings").documents.select("doc_id", "title"))
_add("json_sections", f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, unnest(['customer', 'key', 'title']) AS title {_ORDER}")(lambda s, d: query(C.order_json(s, d, "sections"), ".sections | .title").withColumnRenamed("value", "title"))
_add("jsonl_table", "SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")(lambda s, d: C.nation_jsonl(s, d).tables.select("doc_id", F.explode("rows").alias("r")).select("doc_id", F.col("r")[0].alias("key"), F.col("r")[1].alias("name")))
_add("jsonl_title", "SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, 'Array (' || count(*) || ' items)' AS title FROM nation GROUP BY n_regionkey")(lambda s, d: C.nation_jsonl(s, d).documents.select("doc_id", "title"))
_add("yaml_headings", "SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, unnest(['name', 'place', 'key', 'region']) AS text, unnest([1, 1, 2, 2])::BIGINT AS level FROM nation")(lambda s, d: C.nation_yaml(s, d).headings.select("doc_id", "text", "level"))
_add("event_json_keys", "SELECT CAST(event_id AS VARCHAR) AS doc_id, unnest(json_keys(props)) AS text FROM events")(lambda s, d: parse_documents(C.table(s, d, "events").select(F.col("event_id").cast("string").alias("doc_id"), F.lit("e.json").alias("path"), F.col("props").alias("content")), want=["headings"]).headings.select("doc_id", "text"))

# PDF
_LINES = """
WITH n AS (SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, n_nationkey AS k, n_name AS text, CASE n_nationkey % 4 WHEN 0 THEN 24.0 WHEN 1 THEN 18.0 WHEN 2 THEN 15.0 ELSE 14.0 END / 12.0 AS r, n_nationkey % 2 = 0 AS b, n_nationkey % 3 + 1 AS page FROM nation),
 l AS (SELECT *, CAST(CASE WHEN r >= 2 OR (b AND r >= 1.5) THEN 1 WHEN r >= 1.5 OR (b AND r >= 1.3) THEN 2 WHEN r >= 1.25 OR (b AND r >= 1.15) THEN 3 ELSE 4 END AS BIGINT) AS level FROM n)
"""
_add("pdf_body_size", "SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS doc_id, CAST(12.0 AS DOUBLE) AS body_size FROM nation")(lambda s, d: pdf.body_sizes(C.font_lines(s, d)))
_add("pdf_headings", _LINES + "SELECT doc_id, level, text FROM l")(lambda s, d: pdf.infer_headings(C.font_lines(s, d)).select("doc_id", "level", "text"))
_add("pdf_likely_heading", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, true AS likely FROM nation")(lambda s, d: C.table(s, d, "nation").select("n_nationkey", pdf.likely_heading(F.col("n_name")).alias("likely")))
_add("pdf_title", _LINES + "SELECT doc_id, arg_min(text, k) AS title FROM l WHERE page = 1 AND level <= 2 GROUP BY doc_id")(lambda s, d: pdf.titles(pdf.infer_headings(C.font_lines(s, d))))

# Operators over any rows
_T = C.table
_add("op_filter", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R'")(lambda s, d: G.filter(_T(s, d, "lineitem"), "l_quantity > 40 AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber"))
_add("op_map", "SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_extendedprice * (1 - l_discount) AS net FROM lineitem")(lambda s, d: G.map(_T(s, d, "lineitem"), k="l_orderkey", n="l_linenumber", net="l_extendedprice * (1 - l_discount)"))
_add("op_map_python", "SELECT p_partkey, upper(p_name) AS name FROM part")(lambda s, d: G.map(_T(s, d, "part"), p_partkey="p_partkey", name=G.python(lambda x: x.str.upper(), "string", "p_name")))
_add("op_filter_python", "SELECT p_partkey FROM part WHERE p_size % 7 = 3")(lambda s, d: G.filter(_T(s, d, "part"), G.python(lambda x: x % 7 == 3, "boolean", "p_size")).select("p_partkey"))
_add("op_flat_map", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")(lambda s, d: G.flat_map(_T(s, d, "part"), "split(p_type, ' ')", "word", "p_partkey"))
_add("op_reduce", "SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS result FROM orders GROUP BY o_custkey")(lambda s, d: G.reduce(_T(s, d, "orders"), "o_orderstatus", F.lit(""), lambda a, v: F.concat(a, v), ["o_orderkey"], ["o_custkey"]))
_add("op_take", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10")(lambda s, d: G.take(_T(s, d, "orders").select("o_orderkey", "o_custkey"), 10, "o_orderkey"))
_add("op_skip", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey OFFSET 100")(lambda s, d: G.skip(_T(s, d, "customer").select("c_custkey", "c_name"), 100, "c_custkey"))
_add("op_unique", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")(lambda s, d: G.unique(_T(s, d, "orders"), "o_orderpriority", "o_orderstatus"))
_add("op_unique_by", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")(lambda s, d: G.unique_by(_T(s, d, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey"))
_add("op_group_by", "SELECT n_regionkey::BIGINT AS n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")(lambda s, d: G.group_by(_T(s, d, "nation"), ["n_regionkey"], "n_nationkey", name="n_name").select("n_regionkey", F.array_join(F.transform("items", lambda x: x["name"]), ",").alias("names")))
_add("op_sort_by", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")(lambda s, d: G.sort_by(_T(s, d, "supplier").select("s_suppkey", "s_acctbal"), F.desc("s_acctbal"), "s_suppkey"))
_add("op_find", "SELECT p_partkey, p_name FROM part WHERE p_size > 45 ORDER BY p_partkey LIMIT 1")(lambda s, d: G.find(_T(s, d, "part").select("p_partkey", "p_name", "p_size"), "p_size > 45", "p_partkey").select("p_partkey", "p_name"))
_add("op_any", "SELECT bool_or(c_acctbal < 0) AS result FROM customer")(lambda s, d: G.any(_T(s, d, "customer"), "c_acctbal < 0"))
_add("op_all", "SELECT bool_and(l_quantity > 0) AS result FROM lineitem")(lambda s, d: G.all(_T(s, d, "lineitem"), "l_quantity > 0"))
_add("op_count", "SELECT count(*) AS n FROM lineitem WHERE l_discount > 0.05")(lambda s, d: G.filter(_T(s, d, "lineitem"), "l_discount > 0.05").agg(F.count("*").alias("n")))
_add("chain_filter_sort_take", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")(lambda s, d: G.Chain(_T(s, d, "orders")).filter("o_orderstatus = 'O'").sort_by(F.desc("o_totalprice"), "o_orderkey").take(20).map(o_orderkey="o_orderkey", o_totalprice="o_totalprice"))
_add("chain_skip", "SELECT s_suppkey FROM (SELECT s_suppkey FROM supplier ORDER BY s_suppkey OFFSET 2) ORDER BY s_suppkey LIMIT 5")(lambda s, d: G.Chain(_T(s, d, "supplier"), "s_suppkey").skip(2).take(5).map(s_suppkey="s_suppkey"))
_add("chain_first", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1")(lambda s, d: G.Chain(_T(s, d, "customer"), "c_custkey").filter("c_mktsegment = 'BUILDING'").first().select("c_custkey"))
_add("builder_headings", _BASE + "SELECT doc_id, text FROM h WHERE level = 2 AND pos <= 3")(lambda s, d: Builder(C.markdown(s, d, "headings")).headings(2).take(3).as_headings().select("doc_id", "text"))
_add("builder_skip_count", _BASE + "SELECT doc_id, greatest(nations - 1, 0) AS value FROM d")(lambda s, d: Builder(C.markdown(s, d, "headings")).headings(2).skip(1).count())
_add("builder_map_filter", _BASE + "SELECT doc_id, upper(language) AS value FROM code WHERE language <> 'go'")(lambda s, d: Builder(C.markdown(s, d, "code_blocks")).code().filter("language <> 'go'").map("upper(language)").result())
_add("builder_section_code", _BASE + "SELECT doc_id, content FROM code WHERE n_name = 'NATION_3'")(lambda s, d: Builder(C.markdown(s, d, "sections", "code_blocks")).section("NATION_3").code().as_code().select("doc_id", "content"))

# Conditions
_add("map_headings", _BASE + "SELECT doc_id, level * 10 AS v FROM h")(lambda s, d: G.map(C.markdown(s, d, "headings").headings, doc_id="doc_id", v="level * 10"))
_add("pred_by_level", _BASE + "SELECT doc_id, text FROM h WHERE level IN (1, 3)")(lambda s, d: P.headings_by_level(C.markdown(s, d, "headings").headings, 1, 3).select("doc_id", "text"))
_add("pred_text_contains", _BASE + "SELECT doc_id, text FROM h WHERE contains(lower(text), 'on_1')")(lambda s, d: P.headings_by_text(C.markdown(s, d, "headings").headings, "On_1").select("doc_id", "text"))
_add("pred_text_prefix", _BASE + "SELECT doc_id, text FROM h WHERE starts_with(text, 'A')")(lambda s, d: C.markdown(s, d, "headings").headings.filter(P.by_text_prefix("A")).select("doc_id", "text"))
_add("pred_combine", _BASE + "SELECT doc_id, text FROM h WHERE level = 2 AND starts_with(text, 'NAT') AND contains(lower(text), '_2')")(lambda s, d: C.markdown(s, d, "headings").headings.filter(P.combine(P.by_level(2), P.by_text_prefix("NAT"), P.by_text_contains("_2"))).select("doc_id", "text"))
_add("code_by_language_any_case", _BASE + "SELECT doc_id, content FROM code WHERE language IN ('go', 'bash')")(lambda s, d: P.code_by_language(C.markdown(s, d, "code_blocks").code_blocks, "GO", "Bash").select("doc_id", "content"))
_add("code_by_lines", _BASE + "SELECT doc_id, content FROM code")(lambda s, d: P.code_by_lines(C.markdown(s, d, "code_blocks").code_blocks, 1).select("doc_id", "content"))
_add("code_per_language", _BASE + "SELECT language, count(*) AS n FROM code GROUP BY language")(lambda s, d: C.markdown(s, d, "code_blocks").code_blocks.groupBy("language").agg(F.count("*").alias("n")))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
