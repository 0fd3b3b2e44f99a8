import random

import numpy as np
import pytest
from helpers import ODD, frame, pairs, text

from docloom.llm import jaccard_join, pq, suffix_dedup
from docloom.llm.textvec import Words


def near_copies():
    r = random.Random(3)
    rows = [(i, text(i, r.randint(1, 90))) for i in range(60)]
    for i in range(60, 110):
        words = rows[r.randrange(60)][1].split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(["changed", "words", "baal"])
        rows.append((i, " ".join(words)))
    return rows


def grams(t, n=3):
    w = Words([t or ""]).hash.tolist()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def test_jaccard_join_against_brute_force(spark):
    rows = near_copies() + ODD
    got = pairs(jaccard_join.similar(frame(spark, rows)))
    sets = {}
    for i, t in rows:
        if i is not None and grams(t):
            sets.setdefault(i, grams(t))
    lowest = {}
    for i in sorted(sets):
        lowest.setdefault(sets[i], i)
    want = {}
    for i in sets:
        if lowest[sets[i]] != i:
            want[lowest[sets[i]], i] = 1.0
    heads = sorted(lowest.values())
    for k, a in enumerate(heads):
        for b in heads[k + 1 :]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= jaccard_join.THRESHOLD - 1e-12:
                want[a, b] = j
    assert got.keys() == want.keys() and len(want) > 30
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_keep_one_of_each_group(spark):
    docs = frame(spark, near_copies() + ODD)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    p = pairs(jaccard_join.similar(docs))
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in p:
        x, y = sorted((find(a), find(b)))
        group[y] = x
    all_ids = {r[0] for r in docs.select("doc_id").distinct().collect()}
    assert {i for i in ids if i is not None} == {i for i in all_ids if i is not None and find(i) == i}
    assert ids.count(None) == 2 and ids.count(906) == 1
    assert jaccard_join.similar(docs.limit(0)).count() == 0
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0


def brute_repeats(rows, length):
    seen = {}
    places = {}
    for i, t in rows:
        if i is None or not t or i in places:
            continue
        w = Words([t]).hash.tolist()
        places[i] = w
        for p in range(len(w) - length + 1):
            seen.setdefault(tuple(w[p : p + length]), set()).add(i)
    out = set()
    for i, w in places.items():
        hit = [p for p in range(len(w) - length + 1) if len(seen[tuple(w[p : p + length])]) > 1]
        runs = []
        for p in hit:
            if runs and p <= runs[-1][1]:
                runs[-1][1] = p + length
            else:
                runs.append([p, p + length])
        out |= {(i, a, b) for a, b in runs}
    return out


@pytest.mark.parametrize("length,seed,hot", [(50, 16, 50_000), (50, 16, 3), (12, 4, 50_000), (12, 4, 0), (5, 5, 3)])
def test_repeats_against_brute_force(spark, monkeypatch, length, seed, hot):
    """With seeds brought together and with all or some of them counted as hot ones."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    shared = [text(f"s{k}", 75) for k in range(4)]
    rows = [(i, " ".join([text(i, i * 7 % 90), shared[i % 4], text(i + 500, i % 30), shared[(i + 1) % 4]][: 1 + i % 4])) for i in range(24)]
    rows += [(300, "again and " * 200), (301, "alone again and " * 200)] + ODD
    docs = frame(spark, rows)
    got = [tuple(r) for r in suffix_dedup.repeats(docs, length, seed).select("doc_id", "begin", "end").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_repeats(rows, length) and got
    assert suffix_dedup.repeats(docs.limit(0), length, seed).count() == 0


@pytest.mark.parametrize("files", [False, True])
def test_columns_against_sorted_suffixes(tmp_path, files):
    r = np.random.default_rng(1)
    for t in range(60 if not files else 8):
        strings = [r.integers(1, 4, r.integers(0, 12)) for _ in range(r.integers(1, 6))]
        start = np.concatenate(([0], np.cumsum([len(x) for x in strings])))
        got = suffix_dedup.collection(np.concatenate(strings) if start[-1] else np.zeros(0, int), start, str(tmp_path / f"w{t}") if files else None)
        naive = sorted(([(c, 0) for c in x[i:].tolist()] + [(0, k)], k, len(x) - i) for k, x in enumerate(strings) for i in range(len(x) + 1))

        def common(x, y):
            n = 0
            while x[n] == y[n] and x[n][0]:
                n += 1
            return n

        lcp = [0] + [common(naive[i - 1][0], naive[i][0]) for i in range(1, len(naive))]
        bwt = [int(strings[k][len(strings[k]) - n - 1]) if n < len(strings[k]) else 0 for _, k, n in naive]
        assert [(k, n) for _, k, n in naive] == list(zip(got[0].tolist(), got[1].tolist()))
        assert lcp == got[2].tolist() and bwt == got[3].tolist()


@pytest.mark.parametrize("part", [20_000, 7])
def test_embeddings_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(pq, "PART", part)
    r = np.random.default_rng(2)
    base = r.normal(size=(150, 24))
    x = np.concatenate([base, base[:60] + 0.08 * r.normal(size=(60, 24)), base[:5], base[:1] * 1e200])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(None, [1.0] * 24, 1), (900, None, 1), (901, [], 1), (902, [0.0] * 24, 1), (903, [1.0, 2.0], 1), (904, [float("nan")] * 24, 1), (905, [float("inf")] * 24, 1), (906, [None] * 24, 1), rows[3], (140, rows[141][1], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, list int").repartition(3)
    u = x / np.abs(x).max(1, keepdims=True)
    u = (u / np.linalg.norm(u, axis=1, keepdims=True)).astype(np.float32).astype(float)
    own = {}  # the ids of each vector
    for i, v in enumerate(u):
        own.setdefault(v.tobytes(), set()).add(i)
    own[u[141].tobytes()].add(140)
    vectors = [(np.frombuffer(k), v) for k, v in own.items()]
    links = {(i, j) for i, (a, _) in enumerate(vectors) for j, (b, _) in enumerate(vectors) if i != j and a @ b >= pq.THRESHOLD}
    pairs_ = {(min(vectors[i][1]), min(vectors[j][1])) for i, j in links}
    found = {(a["vec_a"], a["vec_b"]): a["cosine"] for a in pq.near_duplicates(df).collect()}
    assert len(pairs_) > 60 and found.keys() == {(a, b) for a, b in pairs_ if a < b}
    assert all(abs(c - u[a] @ u[b]) < 1e-3 for (a, b), c in found.items())
    head = {i: i for i in range(len(x))}
    for _ in range(20):
        for group in [v for _, v in vectors] + [vectors[i][1] | vectors[j][1] for i, j in links]:
            low = min(head[i] for i in group)
            head |= {i: low for i in group}
    want = {i: (head[i], sum(len(v) for _, v in vectors if i in v), sum(a in mine for mine in [{k for k, (_, v) in enumerate(vectors) if i in v}] for a, _ in links)) for i in head}
    got = {r["vec_id"]: (r["class_id"], r["copies"], r["links"]) for r in pq.classes(df).collect()}
    assert got == want and want[140][1] == 3 and want[141][0] == 140
    assert pq.near_duplicates(df.limit(0)).count() == 0 and pq.classes(df.limit(0)).count() == 0


def test_embeddings_recall_among_many_lists(spark):
    """Near vectors across more lists than one, held against all cosines."""
    r = np.random.default_rng(5)
    base = r.normal(size=(3000, 64))
    x = np.concatenate([base, *(base[:300] + 0.25 * r.normal(size=(300, 64)) for _ in range(3))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i, j in zip(*np.nonzero(s >= pq.THRESHOLD)) if i < j}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r["vec_a"], r["vec_b"]) for r in pq.near_duplicates(df).collect()}
    assert len(want) > 200 and len(got & want) >= 0.97 * len(want)
