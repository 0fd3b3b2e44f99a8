import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ODD, frame, text
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import bpe, decontamination, kneser_ney, lexicon, pii
from docloom.llm.textvec import Words

VOCABULARY = open(bpe.VOCABULARY, "rb").read()
CODEC = bpe.Codec(VOCABULARY)


def reference_ids(texts):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, VOCABULARY.splitlines())}
    return [tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40) | st.text(alphabet="ab 'slre\n\t1,.äé", max_size=40), max_size=5))
def test_bpe_equals_plain_merging(texts):
    ids, count = CODEC.encode_block(texts)
    at = 0
    for t, n, want in zip(texts, count.tolist(), reference_ids(texts)):
        assert ids[at : at + n].tolist() == want
        assert CODEC.decode_bytes(ids[at : at + n]).decode() == t
        at += n


def test_bpe_frames(spark):
    docs = frame(spark, ODD + [(1, "It's 12 o'clock")])
    coded = bpe.encode(docs)
    rows = coded.collect()
    assert len(rows) == len(ODD) + 1 and all(r["round_trip"] for r in rows)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(coded).collect()}
    assert all(back[i] == (t or "") for i, t in ODD if i is not None) and back[1] == "It's 12 o'clock"
    assert bpe.encode(docs.limit(0)).count() == 0


def test_pii_spans_and_redaction(spark):
    r = random.Random(1)
    kinds = {"email": "ann.b{0}@mail.example.com", "phone": "+1 (202) 555-0{0}", "ip": "10.2.{0}.7", "secret": "password={0}f0a9c77d31", "key": "AKIAQ{0}ZLMN8RTYU72X"}
    rows, want = [], set()
    for i in range(120):
        kind = r.choice([*kinds, None, "version"])
        a, b = text(i, 20), text(i + 999, 9)
        if kind in kinds:
            span = kinds[kind].format(r.randint(100, 199))
            rows.append((i, f"{a} {span} {b}"))
            value = span.removeprefix("password=")
            begin = rows[-1][1].index(value)
            want.add((i, begin, begin + len(value), kind))
        else:
            rows.append((i, f"{a} Version 2.0. {b}" if kind else a))
    cards = ["4041894974608795", "4337166598464399"]
    for i, c in enumerate(cards * 4):
        rows.append((500 + i, f"ab {c} 55.63.178.142 cd"))
        want |= {(500 + i, 3, 19, "card"), (500 + i, 20, 33, "ip")}
    docs = frame(spark, rows + ODD)
    got = {(x["doc_id"], x["begin"], x["end"], x["kind"]) for x in pii.spans(docs).collect()}
    assert got == want
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    new = {x["doc_id"]: x for x in out.collect()}
    assert new[500]["text"] == "ab <CARD> <IP> cd" and new[500]["n_chars"] == 17
    assert pii.spans(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0


def brute_tiles(doc, item, least):
    """Greedy string tiling by its definition."""
    used_d, used_i, total = set(), set(), 0
    while True:
        best = (0,)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and a + n not in used_i and b + n not in used_d:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        if best[0] < least:
            return total / len(item)
        n, a, b = best
        used_i |= set(range(a, a + n))
        used_d |= set(range(b, b + n))
        total += n


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_decontamination_against_brute_force(spark, limit):
    items = [(k, text(f"i{k}", 24 + k)) for k in range(6)] + [(90, "too short"), (91, None), (92, ""), (None, text("in", 20))]
    rows = []
    for i in range(24):
        w = (items[i % 6][1]).split()
        k = 6 + i % 8
        rows.append((i, " ".join([text(i, 12), *w[k:], text(i + 50, 7), *w[: k if i % 3 else 0]])))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    docs = frame(spark, rows + ODD)
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontamination.leaks(docs, bench, limit=limit).collect()}
    want = {}
    for i, t in rows + [x for x in ODD if x[0] == 906][:1]:
        d = Words([t]).hash.tolist()
        for k, u in items:
            w = Words([u or ""]).hash.tolist()
            if len(w) >= decontamination.MIN_TILE and (c := brute_tiles(d, w, decontamination.MIN_TILE)) >= decontamination.THRESHOLD:
                want[i, k] = c
    assert got.keys() == want.keys() and want
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = decontamination.decontaminate(docs, bench, limit=limit)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()} - {a for a, _ in want}
    assert decontamination.leaks(docs.limit(0), bench, limit=limit).count() == 0 and decontamination.leaks(docs, bench.limit(0), limit=limit).count() == 0


def brute_model(texts, n):
    """Interpolated modified Kneser-Ney from its definition: P(symbol | context)."""
    counts = [Counter() for _ in range(n + 1)]
    for t in texts:
        laid = kneser_ney.BOS * (n - 1) + t + kneser_ney.EOS
        counts[n].update(laid[i : i + n] for i in range(len(t) + 1))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    ds, ctx = [None], [None]
    for k in range(1, n + 1):
        t = [sum(v == j for v in counts[k].values()) for j in range(5)]
        y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0.5
        ds.append([min(max(j - (j + 1) * y * t[j + 1] / t[j] if t[j] else 0.5 * j, 0.05), j - 0.05) for j in (1, 2, 3)])
        at = defaultdict(list)
        for g, v in counts[k].items():
            at[g[:-1]].append(v)
        ctx.append(at)

    def p(context, symbol):
        k = len(context) + 1
        if k == 1:
            v = ctx[1][""]
            gamma = sum(ds[1][min(x, 3) - 1] for x in v) / sum(v)
            c = counts[1][symbol]
            return (c - ds[1][min(c, 3) - 1] if c else 0) / sum(v) + gamma / (len(v) + 1)
        below = p(context[1:], symbol)
        v = ctx[k].get(context)
        if not v:
            return below
        c = counts[k][context + symbol]
        return (c - ds[k][min(c, 3) - 1] if c else 0) / sum(v) + sum(ds[k][min(x, 3) - 1] for x in v) / sum(v) * below

    return p


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_quality_classifier_against_brute_force(spark, limit):
    n = 3
    rows = [(i, text(i, 25), "en" if i % 2 else None) for i in range(40)] + [(200 + i, "$$ %% ## @@ " * 9 + str(i), "en") for i in range(4)]
    rows += [(i, t, "xx") for i, t in ODD if i != 905] + [(907, "no model for it", "xx")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(200, 0), (1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    model = kneser_ney.fit(docs, labels, n=n, limit=limit)
    got = {(r["doc_id"], r["lang"]): r["perplexity"] for r in model.score(docs).collect()}
    trained = {r[0] for r in docs.filter("doc_id < 40").filter(~kneser_ney.held_out(docs["doc_id"])).select("doc_id").collect()}
    for lang in ("en", None):
        p = brute_model([t for i, t, x in rows if x == lang and i in trained], n)
        for i, t, x in rows:
            if x == lang:
                laid = kneser_ney.BOS * (n - 1) + t + kneser_ney.EOS
                s = sum(math.log(p(laid[k : k + n - 1], laid[k + n - 1])) for k in range(len(t) + 1))
                assert math.isclose(got[i, x], math.exp(-s / (len(t) + 1)), rel_tol=1e-4)
    kept = model.keep(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    good = [r["doc_id"] for r in model.accepted(docs).collect()]
    assert sorted(map(str, ids)) == sorted(map(str, good))
    assert not set(ids) & {200, 201, 202, 203} and ids.count(None) == 2 and ids.count(906) == 2 and {900, 901, 907} <= set(ids)
    assert len(set(ids) & set(range(40))) >= 38
    none = kneser_ney.fit(docs, labels.limit(0), n=n, limit=limit)
    assert none.keep(docs).count() == docs.count()


def test_lexicon_finds_toxic_documents(spark):
    r = random.Random(4)
    bad = ["vilk", "drost", "smarg", "quelp"]
    rows, toxic = [], {}
    for i in range(400):
        w = text(i, 60).split()
        toxic[i] = i % 8 == 0
        if toxic[i]:
            for k in r.sample(range(len(w)), 4):
                w[k] = r.choice(bad)
        rows.append((i, " ".join(w)))
    docs = frame(spark, rows + ODD)
    labels = spark.createDataFrame([(i, int(toxic[i])) for i in range(200)] + [(None, 1), (3, None), (900, 0)], "doc_id long, toxic int")
    found = lexicon.induce(docs, labels)
    assert {found.word[i] for i in (found.polarity >= found.least).nonzero()[0]} == set(bad)
    got = {x["doc_id"] for x in lexicon.toxic(docs, labels, found).collect()}
    assert got == {i for i in toxic if toxic[i]}
    assert lexicon.toxic(docs.limit(0), labels).count() == 0 and lexicon.toxic(docs, labels.limit(0)).count() == 0


def brute_graph(texts, nodes, window):
    """Discounted positive pointwise mutual information from its definition."""
    n = Counter()
    for t in texts:
        w = t.lower().split()
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + window + 1)):
                if w[i] in nodes and w[j] in nodes and w[i] != w[j]:
                    n[w[i], w[j]] += 1
                    n[w[j], w[i]] += 1
    mass = Counter()
    for (x, _), c in n.items():
        mass[x] += c
    total = sum(mass.values())
    pmi = {(x, y): math.log2(c * total / (mass[x] * mass[y])) * c / (c + 1) for (x, y), c in n.items()}
    return {k: v for k, v in pmi.items() if v > 0}


def test_word_graph_walks_and_scores_against_brute_force(spark):
    texts = [text(i, 40) for i in range(30)]
    names = sorted(set(texts[0].split()) | set(texts[1].split()))
    hashes = np.array([int(Words([w]).hash[0]) for w in names], np.uint64)
    by = np.argsort(hashes)
    hashes, names = hashes[by], [names[i] for i in by]
    docs = frame(spark, list(enumerate(texts)) + ODD[2:5])
    graph = lexicon.edges(lexicon.near(docs, hashes, 6))
    got = {(names[r["x"]], names[r["y"]]): r["ppmi"] for r in graph.collect()}
    want = brute_graph(texts, set(names), 6)
    assert got.keys() == want.keys() and len(want) > 100 and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    n = len(names)
    weight = np.zeros((n, n))
    for (x, y), v in want.items():
        weight[names.index(x), names.index(y)] = v
    seeds = [np.array([0, 3]), np.array([5]), np.zeros(0, np.int64)]
    out = weight.sum(1)
    chain = weight / np.where(out > 0, out, 1)[:, None]
    for s, p in zip(seeds, lexicon.walks(graph, n, seeds, 0.4)):
        start = np.zeros(n)
        start[s] = 1 / max(1, len(s))
        stay = chain + np.outer(out == 0, start)
        exact = np.linalg.solve(np.eye(n) - 0.6 * stay.T, 0.4 * start)
        assert np.abs(p - exact).max() < 1e-5
    polarity = np.linspace(-1, 1, n)
    words = lexicon.Lexicon(names, hashes, polarity, 0.2, 0.5)
    strong = {w: p for w, p in zip(names, polarity) if p >= 0.5}
    score = {i: sum(strong.get(w, 0) for w in t.split()) / math.sqrt(len(t.split())) for i, t in enumerate(texts)}
    found = {r["doc_id"]: r["score"] for r in lexicon.toxic(docs, None, words).collect()}
    assert found.keys() == {i for i, v in score.items() if v >= 0.2} and found and all(math.isclose(found[i], score[i]) for i in found)


def test_every_word_is_a_node(spark):
    """A word in 0.5 % of the documents, none of them labelled, is judged by its company; a word of all documents is a node too."""
    rows, labels = [], []
    for i in range(400):
        w = text(i, 50).split()
        if i % 10 == 0:
            w[5] = w[9] = w[13] = "vilk"
        w[20] = "always"
        rows.append((i, " ".join(w)))
        if i < 300:
            labels.append((i, int(i % 10 == 0)))
    rows += [(400, "vilk grusk " * 12), (401, "grusk vilk " * 9)]
    docs, labels = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = lexicon.induce(docs, labels)
    assert {"vilk", "grusk"} <= set(found.word) and "always" not in found.word
    words = {r["word"]: (r["n"], r["toxic"], r["other"]) for r in lexicon.vocabulary(docs, {i: int(i % 10 == 0) for i in range(300)}).collect()}
    assert set(words) == {w for _, t in rows for w in t.lower().split()}
    assert words["grusk"] == (2, 0, 0) and words["always"] == (400, 30, 270) and words["vilk"] == (42, 30, 0)


def test_packed_pairs_are_those_of_all_words(spark, monkeypatch):
    """Sums over packed pairs of several ranges and passes against the definition, over all words."""
    monkeypatch.setattr(lexicon, "MERGE", 200)
    texts = [text(i, 40) for i in range(30)] + ["rare word", "one", "again again again", "a lot " * 700]
    count = Counter(w for t in texts for w in t.lower().split())
    names = sorted(count, key=lambda w: (-count[w], w))
    hashes = np.array([int(Words([w]).hash[0]) for w in names], np.uint64)
    docs = frame(spark, list(enumerate(texts)))
    graph = lexicon.packed(docs, hashes, np.array([count[w] for w in names]), 6)
    assert len(graph._parts) > 1
    weight = np.zeros((len(names), len(names)))
    for (x, y), v in brute_graph(texts, set(names), 6).items():
        weight[names.index(x), names.index(y)] = v
    mass = lexicon.packed_step(graph, len(names), None)(np.ones((1, len(names))))[0]
    some = np.random.default_rng(1).random((2, len(names)))
    got = lexicon.packed_step(graph, len(names), mass)(some)
    assert np.allclose(got, some @ weight, rtol=1e-9, atol=1e-9) and got.any()


def test_word_graph_keeps_few_pairs_and_gives_the_sums_of_all(spark, monkeypatch):
    """Pairs seen once are summed over the texts and are not kept unless their weight is cut at 0; the sums are those of the definition."""
    monkeypatch.setattr(lexicon, "MERGE", 200)
    monkeypatch.setattr(lexicon, "SPAN", 64)
    texts = [text(i, 40) for i in range(30)] + [" ".join(f"rare{i}x{k}" for k in range(30)) for i in range(9)] + ["rare word", "one", "again again again", "a lot " * 700]
    count = Counter(w for t in texts for w in t.lower().split())
    names = sorted(count, key=lambda w: (-count[w], w))
    hashes = np.array([int(Words([w]).hash[0]) for w in names], np.uint64)
    docs = frame(spark, list(enumerate(texts)) + ODD[:2])
    want = brute_graph(texts, set(names), 6)
    weight = np.zeros((len(names), len(names)))
    for (x, y), v in want.items():
        weight[names.index(x), names.index(y)] = v
    graph, step = lexicon.word_graph(docs, hashes, 6)
    some = np.random.default_rng(1).random((2, len(names)))
    assert np.allclose(step(some), some @ weight, rtol=1e-9, atol=1e-9)
    kept = set()
    for r in graph.filter("low >= 0").collect():
        degree, near_by, _ = lexicon._unpack(bytes(r["pairs"]))
        kept |= {(names[x], names[y]) for x, y in zip(np.repeat(r["low"] + np.arange(len(degree)), degree), near_by)}
    assert kept and not any("rare" in x + y for x, y in kept) and sum("rare" in x + y for x, y in want) > 2000


def test_lexicon_takes_rare_words_and_rates_no_copies_twice(spark):
    """A toxic word in 1.2 % of the documents, and a clean text that was copied among the toxic ones under another label."""
    rows, toxic = [], {}
    for i in range(900):
        w = text(i, 50).split()
        toxic[i] = i % 10 == 0
        if toxic[i]:
            for k in (5, 20, 35):
                w[k] = "vilk"
            if i % 80 == 0:
                w[7] = w[21] = "rarely"
        rows.append((i, " ".join(w)))
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(t)) for i, t in toxic.items()], "doc_id long, toxic int")
    found = lexicon.induce(docs, labels)
    assert {w for w, p in zip(found.word, found.polarity) if p >= found.least} == {"vilk", "rarely"}
    sketch = [(r[0], bytes(r[1])) for r in lexicon._signatures(frame(spark, [(1, text(1, 60)), (2, text(1, 60)), (3, text(1, 59) + " baal"), (4, text(4, 60)), (5, text(1, 60))])).collect()]
    assert lexicon.near_copies(sketch, {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}) == {2, 3}


def test_reliabilities_and_span_classifier_against_brute_force():
    r = random.Random(8)
    truth = [r.random() < 0.6 for _ in range(300)]
    votes = [tuple((1 if y == (r.random() < 0.85) else -1) if r.random() < 0.8 else 0 for _ in range(5)) for y in truth]
    kind = [r.randrange(3) for _ in truth]
    weight = [r.randint(1, 4) for _ in truth]
    q, table = pii.reliabilities(np.array(kind), np.array(votes), np.array(weight, float))
    mine = [1 / (1 + math.exp(-1.5 * sum(v))) for v in votes]
    for _ in range(50):
        say = [[[1.0, 2.0, 4.0] if y == 0 else [4.0, 2.0, 1.0] for _ in range(5)] for y in (0, 1)]
        for v, p, w in zip(votes, mine, weight):
            for j in range(5):
                say[0][j][v[j] + 1] += p * w
                say[1][j][v[j] + 1] += (1 - p) * w
        say = [[[c / sum(row) for c in row] for row in half] for half in say]
        share = [(sum(p * w for p, w, k in zip(mine, weight, kind) if k == x) + 1) / (sum(w for w, k in zip(weight, kind) if k == x) + 2) for x in range(3)]
        mine = [1 / (1 + math.exp(-(math.log(share[k] / (1 - share[k])) + sum(math.log(say[0][j][v[j] + 1] / say[1][j][v[j] + 1]) for j in range(5))))) for v, k in zip(votes, kind)]
    assert max(abs(a - b) for a, b in zip(q, mine)) < 1e-6 and np.abs(table[0] - np.array(say[0])).max() < 1e-6
    assert sum((a > 0.5) == y for a, y in zip(q, truth)) > 270
    form = np.array([(k, r.randrange(3), int(y)) for k, y in zip(kind, truth)])
    model = pii.SpanClassifier(form, q, np.array(weight, float))
    p = np.array([model.probability(tuple(x)) for x in form.tolist()])
    for cell, at in model.index.items():  # the gradient of the penalised likelihood is 0
        own = np.array([cell in model._cells(x) for x in form.tolist()])
        assert abs((np.array(weight) * (q - p))[own].sum() - model.w[at]) < 1e-3


def test_pii_forms_take_words_of_any_length():
    import time

    for word in ("aB3/" * 250_000, "ab1" * 350_000, "a:" * 300_000, "1.2-" * 200_000):
        list(pii._found(["x"]))
        began = time.time()
        assert sum(1 for _ in pii._found([f"x {word} y"])) < 5
        assert time.time() - began < 15  # the square of the length would take hours


NEW_KINDS = [("2001:db8::ff00:42:8329", "ip"), ("DE89 3704 0044 0532 0130 00", "iban"), ("078-05-1120", "national"), ("12345678Z", "national"), ("123 Main Street", "address"), ("12 rue de la Paix", "address"), ("Hauptstraße 5", "address")]


@pytest.mark.parametrize("span,kind", NEW_KINDS)
def test_pii_kinds(span, kind):
    found = {(a, b): votes for a, b, k, votes, _ in pii.candidates(f"ab {span} cd", 0, len(span) + 6) if k == kind}
    assert sum(found[3, 3 + len(span)]) >= 2
    assert pii.mod_97("DE89370400440532013000") and not pii.mod_97("DE88370400440532013000")
    assert pii.national("12345678A") == -1 and pii.valid_v6("::1") and not pii.valid_v6("1:2:3")


def test_leaks_of_repeated_ids_are_those_of_one_text(spark):
    item = text("item", 40).split()
    whole, cut = " ".join(item), " ".join([*item[:12], "x y z", *item[12:24], "u v w", *item[24:34]])
    bench = spark.createDataFrame([(1, whole)], "item_id long, text string")
    for limit in (1 << 26, 0):
        got = decontamination.leaks(frame(spark, [(1, cut), (1, whole), (2, cut)]), bench, limit=limit).collect()
        assert sorted((r["doc_id"], r["coverage"], r["tiles"]) for r in got) == [(1, 1.0, 1), (2, 0.85, 3)]
