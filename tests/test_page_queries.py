"""Queries over web pages against their SQL, on titles that were cut within a character reference."""

import duckdb
import pytest

import __spark_entry__
from docloom.sources import html

CUT = ["a&amp;&amp;&amp", "b &amp; c&am", "d&quot", "e&lt", "f&#39", "g&#39;s &lt;h&gt; i&", "&amp;amp;lt j&amp;lt"]
PAGE = "<!DOCTYPE html><html><head><title>{0}</title><script>var a = 1 &amp 2;</script></head><body><nav><ul><li><a href='/?a=1&amp=2'>{0}</a></li></ul></nav><article><h1>{0}</h1><p><b>{0}</b> and {0}</p></article></body></html>"


@pytest.mark.parametrize("name", ["html_title", "html_h1", "html_readable", "html_sections", "html_all_lists"])
def test_references_without_a_semicolon(spark, tmp_path, name):
    rows = [(k, f"https://example.test/{k}", PAGE.format(x).replace("'/?a=1&amp=2'", '"/"')) for k, x in enumerate(CUT)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def test_references_as_browsers_read_them():
    page = PAGE.format("a&amp b")
    assert html.parse(page).title == "a& b" and html.parse(page, open_references=False).title == "a&amp b"
    links = html.parse(page, readability=False, open_references=False).lists
    assert len(links) == 1 and html.parse("<p>x<a href='/?a=1&b=2'>y</a></p>", open_references=False).links[0]["url"] == "/?a=1&b=2"
