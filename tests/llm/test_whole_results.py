"""Results that must be whole: what an operator finds for one of several rows it finds for all of them."""

import pytest
from helpers import ODD, frame, text
from test_near_duplicates import grams, near_copies

from docloom.llm import common, jaccard_join, kneser_ney, pii


@pytest.mark.parametrize("crowd,limit", [(200_000, 1 << 26), (3, 0)])
def test_jaccard_classes_against_brute_force(spark, monkeypatch, crowd, limit):
    """Both with and without broadcasts, and with crowds that are split."""
    monkeypatch.setattr(jaccard_join, "_CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "_PAIR_BLOCK", crowd)
    monkeypatch.setattr(jaccard_join, "checked_broadcast", lambda df, row_bytes: common.checked_broadcast(df, row_bytes, limit))
    base = text("copied", 60)
    rows = near_copies() + ODD
    rows += [(200 + i, base) for i in range(8)] + [(300 + i, base.replace(base.split()[30], "other")) for i in range(4)]
    # one id with two texts, each with copies of its own, and the lowest of both
    rows += [(150, text("one", 50)), (150, text("one", 50) + " more"), (151, text("one", 50)), (152, text("one", 50) + " more"), (153, text("two", 40)), (150, text("two", 40))]
    sets = {}
    for i, t in rows:
        if i is not None and grams(t):
            sets.setdefault(grams(t), set()).add(i)
    links = {x: {y for y in sets if y != x and len(x & y) / len(x | y) >= jaccard_join.THRESHOLD - 1e-12} for x in sets}
    head = {}

    def find(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for x, own in sets.items():
        for group in [own, *(own | sets[y] for y in links[x])]:
            low = min(map(find, group))
            for i in group:
                head[find(i)] = low
    want = {}
    for i in {i for own in sets.values() for i in own}:
        mine = [x for x, own in sets.items() if i in own and (len(own) > 1 or links[x])]
        if mine:
            want[i] = (find(i), min(min(sets[x]) for x in mine), sum(len(sets[x]) for x in mine), sum(len(links[x]) for x in mine))
    docs = frame(spark, rows)
    got = [(r["doc_id"], (r["class_id"], r["set_id"], r["copies"], r["links"])) for r in jaccard_join.classes(docs).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert want[300] == (200, 300, 4, 1) and want[207] == (200, 200, 8, 1) and len(want) > 40
    assert jaccard_join.classes(docs.limit(0)).count() == 0


def test_jaccard_candidates_of_near_copies_are_told_a_few_times_only(spark):
    """Not once for each n-gram that a pair shares, wherever its n-grams go."""
    base = text("crowd", 400).split()
    rows = [(i, " ".join(base[: 9 * i] + [f"own{i}"] + base[9 * i + 1 :])) for i in range(40)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for key, value in zip(old, ("60", "false")):
            spark.conf.set(key, value)
        docs = frame(spark, rows).select("doc_id", "text")
        shared = jaccard_join._order(docs, 3)
        told = jaccard_join._told(jaccard_join._prefix_rows(docs, 3, 0.7, shared), 0.7)
        times = sum(len(r["pairs"]) for r in told.collect()) // sum(jaccard_join._PAIR)
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert 780 <= times < 780 * 15
    assert {(r["class_id"], r["links"]) for r in jaccard_join.classes(docs).collect()} == {(0, 39)}


def test_jaccard_candidates_have_enough_left_after_what_they_share_first(spark):
    """Sets of 70 and 100 n-grams must share all of the smaller; one n-gram somewhere in both prefixes makes no candidate."""
    rows = []
    for k in range(200):
        rows.append((2 * k, " ".join([f"a{k}w{i}" for i in range(69)] + [f"s{k}w{i}" for i in range(3)])))
        rows.append((2 * k + 1, " ".join([f"b{k}w{i}" for i in range(99)] + [f"s{k}w{i}" for i in range(3)])))
    docs = frame(spark, rows).select("doc_id", "text")
    shared = jaccard_join._order(docs, 3)
    doc, g = jaccard_join.sets([t for _, t in rows], 3)
    g, doc, _, keep, _, size = jaccard_join._prefixes(doc, g, shared.value, 0.7)
    assert set(size) == {70, 100} and len(g[keep]) - len(set(g[keep])) >= 10
    assert jaccard_join._candidates(jaccard_join._prefix_rows(docs, 3, 0.7, shared), 0.7).count() <= 3


CARDS = ["4111 1111 1111 1111", "4111-1111-1111-1111", "5500 0055 5555 5559", "4012-8888-8888-1881", "3782 822463 10005"]
PHONES = ["+33 1 23 45 67 89", "+49 30 12345678", "+1 (202) 555-0143"]


def test_pii_finds_separated_cards_and_phones_in_other_groups(spark):
    rows, want = [], set()
    for i in range(150):
        kind, span = [("card", CARDS[i % 5]), ("phone", PHONES[i % 3]), (None, "Version 2.0.")][i % 3 if i % 2 else i % 2 + (i // 2) % 2]
        rows.append((i, f"{text(i, 12)} {span} {text(i + 500, 6)}"))
        if kind:
            begin = rows[-1][1].index(span)
            want.add((i, begin, begin + len(span), kind))
    docs = frame(spark, rows + ODD)
    got = [(x["doc_id"], x["begin"], x["end"], x["kind"]) for x in pii.spans(docs).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {k for _, _, _, k in want} == {"card", "phone"}
    for r in pii.redact(docs).filter("doc_id < 150").collect():
        assert not set("13456789") & set(r["text"])


def test_pii_forms_propose_whatever_others_propose():
    for span in CARDS:
        found = {(a, b, kind) for a, b, kind, _, _ in pii.candidates(f"ab {span} cd", 0, len(span) + 6)}
        assert (3, 3 + len(span), "card") in found
    for span in [*PHONES, "01 23 45 67 89", "0171 2345678"]:
        found = {(a, b, kind) for a, b, kind, _, _ in pii.candidates(f"ab {span} cd", 0, len(span) + 6)}
        assert (3, 3 + len(span), "phone") in found


def test_pii_overlaps_leave_nothing_that_was_accepted():
    assert pii.resolve([(0, 14, "phone", 0.9), (0, 19, "card", 0.8)]) == [(0, 19, "card", 0.8)]
    assert pii.resolve([(0, 9, "key", 0.6), (0, 9, "secret", 0.9), (20, 25, "ip", 0.7)]) == [(0, 9, "secret", 0.9), (20, 25, "ip", 0.7)]
    assert pii.resolve([(0, 9, "key", 0.99), (0, 9, "secret", 0.97)]) == [(0, 9, "secret", 0.97)]
    assert pii.resolve([(0, 9, "key", 0.6), (5, 15, "phone", 0.9)]) == [(0, 5, "key", 0.6), (5, 15, "phone", 0.9)]


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_quality_is_decided_for_each_row(spark, limit):
    junk = "$$ %% ## @@ " * 9
    rows = [(i, text(i, 25)) for i in range(60)]
    rows += [(None, junk), (None, text("good", 25)), (3, junk), (70, junk), (71, junk), (71, text("also good", 25))]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1) for i in range(60) if i != 3], "doc_id long, quality int")
    kept = [tuple(r) for r in kneser_ney.fit(docs, labels, n=3, limit=limit).keep(docs).select("doc_id", "text").collect()]
    assert not [i for i, t in kept if t == junk]
    assert {(None, text("good", 25)), (71, text("also good", 25)), (3, text(3, 25))} <= set(kept)
