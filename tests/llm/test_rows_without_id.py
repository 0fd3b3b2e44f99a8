import pytest
from helpers import ODD, frame, text

from docloom.llm import decontamination


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_leaks_into_rows_without_an_id_are_removed(spark, limit):
    item = text("item", 40)
    leaked = f"{text(1, 9)} {item} {text(2, 9)}"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = frame(spark, [(None, leaked), (None, leaked), (None, text(3, 30)), (5, leaked), (6, text(4, 30))] + ODD)
    kept = decontamination.decontaminate(docs, bench, limit=limit)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
    assert not [t for _, t in rows if t == leaked] and (None, text(3, 30)) in rows and len(rows) == docs.count() - 3
    named = docs.filter("doc_id IS NOT NULL")
    assert decontamination.decontaminate(named, bench, limit=limit).count() == named.count() - 1
