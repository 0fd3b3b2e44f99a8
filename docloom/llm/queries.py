"""Queries over the corpus operators, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontamination, jaccard_join, kneser_ney, lexicon, pii, pq, sharding, suffix_dedup, token_counts
from docloom.llm.common import materialise, read, shared_dir


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the induced lexicon finds toxic."""
    return lexicon.toxic(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they decode to its text."""
    return bpe.encode(read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and secrets in every document."""
    return pii.spans(read(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that leaked into a document."""
    return decontamination.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, rack and shard of every document."""
    return sharding.assign(read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches, the second of which is sent twice.

    1: every document is inserted under space-1 and, counted without marks,
    under piece-2.  2: documents that are labelled as of low quality are
    deleted under both.  3: the piece-2 counts of the others are revised to
    take in marks.
    """
    import uuid

    columns = ["doc_id", "source", "lang", "text"]
    counted = read(spark, sf_dir, "documents").select(*columns)
    counted = counted.select("doc_id", "source", "lang", token_counts.space_tokens(F.col("text")).alias("s"), token_counts.word_tokens(F.col("text")).alias("w"), token_counts.piece_tokens(F.col("text")).alias("p"))
    low = read(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct().withColumn("low", F.lit(True))
    counted = materialise(counted.join(low, "doc_id", "left"), "counts")
    gone, stay = counted.filter("low"), counted.filter("low IS NULL")
    change = token_counts.change
    rollup = token_counts.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("0001", change("insert", "space-1", counted, new=F.col("s")).union(change("insert", "piece-2", counted, new=F.col("w"))))
    second = change("delete", "space-1", gone, old=F.col("s")).union(change("delete", "piece-2", gone, old=F.col("w")))
    rollup.commit("0002", second)
    rollup.commit("0003", change("revise", "piece-2", stay, old=F.col("w"), new=F.col("p")))
    rollup.commit("0002", second)
    return rollup.totals()


def op6_token_counts_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals under two vocabularies of the encoder: all documents are inserted under both, and those of low quality are deleted."""
    import uuid

    docs, low = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct().withColumn("low", F.lit(True))
    counted = token_counts.bpe_counts(docs, {"bpe-50k": bpe.VOCABULARY, "bpe-multi-50k": bpe.VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")})
    counted = materialise(counted.join(low, "doc_id", "left"), "counts")
    rollup = token_counts.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    for batch, op, rows, side in (("0001", "insert", counted, "new"), ("0002", "delete", counted.filter("low"), "old")):
        parts = [token_counts.change(op, v, rows, **{side: F.col(f"`{v}`")}) for v in ("bpe-50k", "bpe-multi-50k")]
        rollup.commit(batch, parts[0].union(parts[1]))
    rollup.compact()
    return rollup.totals()


OP6_SQL = """
WITH low AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
 kept AS (SELECT source, lang, text FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM low WHERE doc_id IS NOT NULL)),
 counted AS (
  SELECT source, lang, 'space-1' AS tokenizer, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'piece-2', len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+|[^ \\t\\n\\r\\f\\p{L}\\p{N}]')) FROM kept)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM counted GROUP BY ALL"""


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of words that lies in a passage of 50 words or more which another document has too."""
    return suffix_dedup.repeats(read(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with its class of nearly equal ones and the number of its links."""
    return pq.classes(read(spark, sf_dir, "embeddings"))


OP8_SQL = f"""
WITH RECURSIVE u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
 v AS (SELECT min(vec_id) AS rep, e, count(*) AS copies FROM u GROUP BY e),
 link AS (SELECT a.rep AS a, b.rep AS b FROM v a JOIN v b ON a.rep <> b.rep AND list_cosine_similarity(a.e, b.e) >= {pq.THRESHOLD}),
 reach(a, b) AS (SELECT rep, rep FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
 class AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
 n AS (SELECT a AS rep, count(*) AS links FROM link GROUP BY a)
SELECT u.vec_id, class.class_id, v.copies, coalesce(n.links, 0) AS links
FROM u JOIN v ON u.e = v.e JOIN class ON class.rep = v.rep LEFT JOIN n ON n.rep = v.rep"""


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is similar to another one, with its class and the number of its links."""
    return jaccard_join.classes(read(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that isn't rejected, with its perplexity and the threshold of its language and length."""
    docs = read(spark, sf_dir, "documents")
    return kneser_ney.fit(docs, read(spark, sf_dir, "labels")).accepted(docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_sharding": sharding.assign_sql(), "op6_token_counts": OP6_SQL, "op8_embedding_near_dedup": OP8_SQL}
