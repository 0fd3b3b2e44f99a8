import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id long, threshold double, perplexity double, seed string, part int"
WORDS = [f"{a}{b}" for a in "ba de fi go ku lam nor pit rus ves".split() for b in "al en im or us ta ri".split()]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, rows, partitions=3):
    """Documents with clashing extra columns; rows are (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), 7, 0.5, 1.0, "x", 1) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


#: Rows that every operator must take: nulls, empty and odd texts, a very long one, rows that repeat.
ODD = [(None, None), (None, "only words without an id " * 8), (900, None), (901, ""), (902, " \n\t "), (903, "x"), (904, "äöü \U0001f600 \x00 ß"), (905, text(5, 60_000)), (906, text("odd", 80)), (906, text("odd", 80))]


def pairs(df):
    return {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in df.collect()}
