import uuid

from helpers import ODD, frame, text

from docloom.llm import sharding, token_counts
from docloom.llm.common import shared_dir


def test_only_subtrees_of_changed_weights_move(spark):
    docs = frame(spark, [(i, "x") for i in range(3000)] + ODD)
    before = {"a": {"r": {"s": 1.0, "t": 1.0}}, "b": {"r": {"s": 2.0, "t": 1.0}, "q": {"s": 1.0}}}
    after = {"a": {"r": {"s": 1.0, "t": 1.0}}, "b": {"r": {"s": 2.0, "t": 1.0}, "q": {"s": 2.0}}}
    rows = sharding.moved(docs, before, after).collect()
    assert rows and all(r["to_path"].startswith("b/") for r in rows)  # b weighs more than before, and q in it
    assert all(r["to_path"].startswith("b/q/") for r in rows if r["from_path"].startswith("b/"))
    share = {r[0]: r[1] for r in sharding.assign(docs, before).groupBy("region").count().collect()}
    assert 0.28 < share["a"] / docs.count() < 0.39
    assert sharding.assign(docs).count() == docs.count() and sharding.assign(docs.limit(0)).count() == 0


def test_rollup_is_idempotent_and_signed(spark):
    docs = frame(spark, [(i, text(i, 5 + i % 3), "en" if i % 2 else None) for i in range(20)] + ODD)
    from pyspark.sql import functions as F

    n = token_counts.space_tokens(F.col("text"))
    rollup = token_counts.Rollup(spark, f"{shared_dir(spark)}/test-rollup-{uuid.uuid4().hex}")
    first = token_counts.change("insert", "t1", docs, new=n)
    assert rollup.commit("1", first) and not rollup.commit("1", first)
    rollup.commit("2", token_counts.change("delete", "t1", docs.filter("doc_id < 5"), old=n))
    rollup.commit("3", token_counts.change("revise", "t1", docs.filter("doc_id = 7"), old=n, new=n + 100))
    got = {r["lang"]: (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    for lang in ("en", None):
        kept = [(i, len((t or "").split(" ")) if (t or "").strip() else 0) for i, t, x in rows if x == lang and not (i is not None and i < 5)]
        assert got[lang][0] == len(kept)
    assert token_counts.Rollup(spark, f"{shared_dir(spark)}/nothing").totals().count() == 0
    rollup.commit("4", token_counts.change("delete", "t1", docs.limit(0), old=n))
    assert rollup.batches() == ["1", "2", "3", "4"]


def test_rollup_claims_and_compaction(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = frame(spark, [(i, text(i, 5)) for i in range(12)])
    n = token_counts.space_tokens(F.col("text"))
    folder = f"{shared_dir(spark)}/test-rollup-{uuid.uuid4().hex}"
    one, two = token_counts.Rollup(spark, folder), token_counts.Rollup(spark, folder)
    assert not one.compact()
    first = token_counts.change("insert", "t", docs, new=n)
    monkeypatch.setattr(two, "committed", lambda batch: False)  # as if both had looked before either wrote
    assert one.commit("1", first) and not two.commit("1", first)
    total = lambda r: [(x["n_docs"], x["n_tokens"]) for x in r.totals().collect()]
    assert total(one) == [(12, 60)] and len(one._names("data")) == 1
    assert one.compact() and total(one) == [(12, 60)] and not one.compact() and not one.commit("1", first)
    one.commit("2", token_counts.change("delete", "t", docs.filter("doc_id < 2"), old=n))
    assert total(one) == [(10, 50)] and one.compact() and total(one) == [(10, 50)]
    assert one.batches() == ["1", "2"] and len(one._names("data")) == 3  # the first base and batch 2 may still be read
    fs, p = one._fs("commits/3")
    fs.create(p).close()  # a writer died between its claim and its word
    assert not one.committed("3") and one.commit("3", first) and total(one) == [(22, 110)]


def test_counts_of_two_vocabularies(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    from docloom.llm import bpe

    paths = {"a": bpe.VOCABULARY, "b": bpe.VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")}
    rows = [(1, "It's 12 o'clock, été"), *ODD]
    got = token_counts.bpe_counts(frame(spark, rows), paths).collect()
    assert len(got) == len(rows)
    for v, path in paths.items():
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        assert sorted(r[v] for r in got) == sorted(len(plain.encode_ordinary(t or "")) for _, t in rows)
