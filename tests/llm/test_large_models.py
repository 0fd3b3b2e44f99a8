"""A quality model beyond the limit of a broadcast."""

import math

import numpy as np
import pytest
from helpers import text

from docloom.llm import kneser_ney


@pytest.mark.parametrize("local", [True, False])
def test_a_large_model_scores_without_moving_the_documents(spark, monkeypatch, local):
    """The reviewer saw the quality stage fill the disk on 6 GB: each n-gram of each document was joined with the model."""
    monkeypatch.setattr(kneser_ney, "_SHARD_ROWS", 100)
    rows = [(i, text(i, 25), "en" if i % 3 else "de") for i in range(90)] + [(200, "$$ %% ## @@ " * 9, "en"), (None, "", "en"), (201, None, "de"), (202, "no model", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(90)], "doc_id long, quality int")
    small = kneser_ney.fit(docs, labels, n=3)
    if not local:  # a shared folder of another file system
        monkeypatch.setattr(kneser_ney, "local_folder", lambda spark: None)
    large = kneser_ney.fit(docs, labels, n=3, limit=0)
    plan = large.keep(docs)._jdf.queryExecution().toString()
    assert local is not ("Join" in plan)
    a, b = ({(r["doc_id"], r["lang"]): r["perplexity"] for r in m.score(docs).collect()} for m in (small, large))
    assert a.keys() == b.keys() and all(x == b[k] if x is None else math.isclose(x, b[k], rel_tol=1e-5) for k, x in a.items())
    assert sorted(map(str, small.keep(docs).collect())) == sorted(map(str, large.keep(docs).collect()))
    if local:
        table, files = small.shared.value, large.shared.value
        assert isinstance(files, kneser_ney.MappedTable) and table.unknown == files.unknown
        places = [np.flatnonzero(t.full) for t in (table, files)]
        assert (places[0] == places[1]).all() and all(np.array_equal(getattr(table, c)[places[0]], getattr(files, c)[places[1]], equal_nan=c != "key") for c in ("key", "logp", "backoff"))
        assert (files.find(table.key[places[0]]) == places[0]).all() and not files.full[-1]
