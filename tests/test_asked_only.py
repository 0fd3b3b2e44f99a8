"""Parsers make only what is asked for, with the same results."""

import json

import pyarrow as pa
import pytest

from docloom import corpora
from docloom.sources import data, reader
from docloom.sources.reader import Registry, parse_documents

TEXTS = ['{"b": 1, "a": {"c": {"d": {"e": {"f": 1}}}}}', '{"a": {"c": {"d": {"e": {"g": 1}}}}, "b": 2}', '{"1": 1}', "[{\"a\": 1}, 2]", "[]", "3", '{"a": {"a": 1}}', '{"a": 1}', "{}", '{"a": 2}', "{broken", json.dumps({f"k{i}": i for i in range(300)})]


@pytest.mark.parametrize("name", ["json", "jsonl", "yaml"])
def test_only_what_is_asked_for(name):
    texts = TEXTS + (["1: a\ntrue: b\n", "'1': a\n'True': b\n", "- 1: x\n- y\n"] if name == "yaml" else [])
    r = Registry()
    for text in texts * 2:  # the second time from what was seen
        try:
            whole = r.parse(name, text.encode()).finish()
        except Exception as e:
            with pytest.raises(type(e)):
                r.parse(name, text.encode(), want=frozenset(["headings"]), readable=False)
            continue
        for want in ([], ["headings"], ["sections"], ["headings", "sections"]):
            some = r.parse(name, text.encode(), want=frozenset(want), readable=False).finish()
            assert (some.title, some.line_count, some.tables, some.readable_text) == (whole.title, whole.line_count, whole.tables, "")
            assert all(getattr(some, k) == (getattr(whole, k) if k in want else []) for k in ("headings", "sections"))


def test_documents_of_the_same_keys_are_built_once():
    data._SEEN.clear()
    asked = {"want": frozenset(["headings", "sections"]), "readable": False}
    a, b = (data.parse_json(json.dumps({"key": k, "in": {"name": k}}), **asked) for k in range(2))
    assert a.headings is b.headings and a.sections is b.sections and a.readable_text == ""
    for k in range(data._MOST_SEEN + 5):
        data.parse_json(json.dumps({f"key{k}": 1}), **asked)
    assert len(data._SEEN) <= data._MOST_SEEN


def test_lists_by_columns():
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.list_(pa.string()))]))
    one, two = [{"a": 1, "b": ["x"]}, {"a": None, "b": None}], [{"a": 3}]
    for values in ([one, [], two], [one] * 5 + [two] + [one], [], [[], []]):
        got = reader._lists(values, kind)
        assert got.type == kind and got.equals(pa.array(values, kind))


def test_extensions_get_all_that_is_found(spark):
    r = Registry()
    r.extend("json", lambda s, text: s.add_heading(9, f"{len(s.sections)} {len(s.readable_text)}"))
    docs = spark.createDataFrame([("1", "x.json", '{"a": 1}'), ("2", "x.json", '{"a": 2}')], "doc_id string, path string, content string")
    got = parse_documents(docs, want=["headings"], registry=r, readable=False).headings.select("text").collect()
    assert sorted(x[0] for x in got) == ["1 12", "1 12", "a", "a"]


def test_orders_are_spread_before_they_are_parsed(spark, tmp_path):
    orders = [(i, i % 7, f"p{i % 5}") for i in range(5000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, f"c{i}", "m") for i in range(7)], "c_custkey long, c_name string, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    parsed = corpora.order_json(spark, str(tmp_path), "headings")
    plan = parsed.parsed._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan.split("MapInArrow")[1] and parsed.headings.count() == 30_000
    assert parsed.documents.filter("readable_text IS NOT NULL").count() == 0
