"""Suffix-array dedup: passages that documents share, word for word.

A passage of LENGTH words is bound to hold one of the seeds that winnowing
takes from its text (the least hash of every LENGTH - SEED + 1 neighbouring
runs of SEED words), and both of its documents take the same one.  So only
seeds that occur in more than one document are followed up: the words around
each of their occurrences, far enough for every passage that the seed stands
for, are brought together by seed and read in the order of the seeds, one
collection at a time.  A seed of more than HOT places isn't brought together:
the hashes of the passages around it are counted by the document instead,
summed on the scan's side, and those of several documents are joined back.

There the suffix array of the strings is built by columns.  Each round inserts
one more symbol of every string, from the right: where the longer suffix
belongs follows from where the shorter one stands, and the collection's
Burrows-Wheeler transform and its common prefixes are updated by one merge in
order.  Suffixes whose neighbours share LENGTH words or more, and which belong
to different documents, start a passage.

The columns of a collection of up to IN_MEMORY symbols are arrays in memory;
those of a larger one are files in the shared folder that every round writes
anew from front to back.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import among, bitmap, bounded_batches, checked_broadcast, discard, materialise, shared_dir, tidy
from docloom.llm.textvec import Words, gram_hashes, sliding_min, text_parts

LENGTH = 50
SEED = 16
#: Symbols that are collected, in whole seeds, before a suffix array is built.
COLLECTION = 400_000
#: Places of a seed from which its passages are found by their hashes.
HOT = 50_000
IN_MEMORY = 1 << 25


class Columns:
    """Makes the columns of one collection, in memory or as files."""

    def __init__(self, folder: str | None):
        self.folder, self.made, self.old = folder, [], []
        if folder:
            os.makedirs(folder)

    def new(self, size: int, kind) -> np.ndarray:
        if not self.folder:
            return np.empty(size, kind)
        path = f"{self.folder}/{uuid.uuid4().hex}"
        self.made.append(path)
        return np.memmap(path, dtype=kind, mode="w+", shape=(max(1, size),))[:size]

    def turn(self) -> None:
        """Ends a round: the files of the one before are not needed any more."""
        for path in self.old:
            os.unlink(path)
        self.old, self.made = self.made, []

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def _least(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum over places a + 1 to b, from the minima over powers of two."""
    width = b - a
    k = np.maximum(0, np.frexp(width.astype(np.float64))[1] - 1)
    out = np.empty(len(a), np.int32)
    for level in np.unique(k):
        at = np.flatnonzero(k == level)
        out[at] = np.minimum(levels[level][a[at] + 1], levels[level][b[at] - (1 << int(level)) + 1])
    return out


def collection(symbols: np.ndarray, start: np.ndarray, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of several strings, by columns: (string, suffix length, common prefix with the suffix before, BWT symbol).

    symbols holds the strings one after another, from start[i] to start[i + 1],
    as numbers from 1 on.  Ends of strings are 0, less than any symbol, and
    order like the strings.
    """
    columns = Columns(folder)
    n, size = len(start) - 1, np.diff(start)
    symbols = symbols.astype(np.int64)

    def before(which: np.ndarray, length: int) -> np.ndarray:
        """Symbol before the suffix of that length; 0 at the string's begin."""
        there = size[which] > length
        return np.where(there, symbols[np.where(there, start[which + 1] - length - 1, 0)] if len(symbols) else 0, 0)

    try:
        first, tail = np.zeros(n, np.int64), np.arange(n)
        string, length, lcp = np.arange(n, dtype=np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        bwt = before(np.arange(n), 0)
        place = np.arange(n)  # of the last inserted suffix of each string
        for r in range(1, int(size.max(initial=0)) + 1):
            live = np.flatnonzero(size >= r)
            c, at = symbols[start[live + 1] - r], place[live]
            by = np.lexsort((at, c))
            live, c, at = live[by], c[by], at[by]
            # the suffixes are in order of (first symbol, place of the rest)
            lo, hi = np.searchsorted(first, c, "left"), np.searchsorted(first, c, "right")
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                less = open_ & (tail[np.minimum(mid, len(tail) - 1)] < at)
                lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            spot = lo + np.arange(len(live))
            total = len(first) + len(live)
            old = np.ones(total, bool)
            old[spot] = False
            levels, k = [lcp], 1
            while 2 * k <= len(lcp):
                level = columns.new(len(lcp) - 2 * k + 1, lcp.dtype)
                np.minimum(levels[-1][:-k], levels[-1][k:], out=level)
                levels.append(level)
                k *= 2

            def merged(had: np.ndarray, more) -> np.ndarray:
                out = columns.new(total, had.dtype)
                out[old] = had
                out[spot] = more
                return out

            first, tail = merged(first, c), merged(tail, at)
            longer = merged(lcp, 0)
            for where in (spot, spot[spot + 1 < total] + 1):
                same = where[(where > 0) & (first[where] == first[where - 1])]
                longer[where] = 0
                longer[same] = 1 + _least(levels, tail[same - 1], tail[same])
            lcp, string, length = longer, merged(string, live), merged(length, r)
            bwt = merged(bwt, before(live, r))
            moved = np.flatnonzero(old)  # new place of each old one
            shifted = columns.new(total, tail.dtype)
            shifted[:] = moved[tail]
            shifted[: n] = np.arange(n)
            tail = shifted
            place[live] = spot
            columns.turn()
        return tuple(np.array(x) for x in (string, length, lcp, bwt))
    finally:
        columns.close()


def _winnowed(words: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hash, place of its first word) of the seeds: in each window of runs the least hash, all of equals."""
    g, place = words.grams(k)
    if not len(g):
        return g, place
    doc = words.doc[place]
    least = sliding_min(g, window)
    whole = doc[: len(least)] == doc[window - 1 :] if len(least) else np.zeros(0, bool)
    least = np.where(whole, least, np.uint64(0xFFFFFFFFFFFFFFFF) if len(least) else least)
    # a run is a seed if it is the least of some whole window that holds it
    chosen = np.zeros(len(g), bool)
    if len(least):
        pad = np.full(window - 1, np.uint64(0))
        highest = ~sliding_min(~np.concatenate([pad, np.where(whole, least, np.uint64(0)), pad]), window)
        chosen = (highest == g) & (g > 0)
    at = np.flatnonzero(chosen)
    return g[at], place[at]


class _Spread:
    """Hashes with the number of their places and the least and greatest of their documents, summed from time to time."""

    schema = pa.schema([("hash", pa.int64()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, g: np.ndarray, doc: np.ndarray) -> None:
        self.held.append((g, doc))
        self.size += len(g)

    def flush(self) -> pa.RecordBatch:
        g, doc = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        by = np.argsort(g, kind="stable")
        g, doc = g[by], doc[by]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
        lo, hi = (f.reduceat(doc, first) if len(first) else doc for f in (np.minimum, np.maximum))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (g[first].view(np.int64), np.diff(np.append(first, len(g))), lo, hi)], schema=self.schema)


def _spread(docs: DataFrame, hashes) -> DataFrame:
    """(hash, n, lo, hi): how many places each hash has and its least and greatest document; hashes gives (hash, place) of a block's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Spread()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part, texts in text_parts(batch, 1):
                words = Words(texts)
                g, place = hashes(words)
                seen.add(g, ids[words.doc[place] + part.start])
                if seen.size > 1_000_000:
                    yield seen.flush()
        if seen.held:
            yield seen.flush()

    out = docs.select("doc_id", "text").mapInArrow(tidy(run), "hash long, n long, lo long, hi long")
    return out.groupBy("hash").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi")


def _strings(docs: DataFrame, k: int, length: int, shared) -> DataFrame:
    """(seed, doc_id, place, words): the words around each place of a repeated seed that isn't hot, as 32 bits of their hashes."""
    schema = pa.schema([("seed", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, hot = shared.value
        for batch in batches:
            for part, texts in text_parts(batch, 1):
                words = Words(texts)
                g, place = _winnowed(words, k, length - k + 1)
                keep = among(*again, g) & ~among(*hot, g)
                g, place = g[keep], place[keep]
                doc = words.doc[place]
                lo = np.maximum(place - (length - k), words.first[doc])
                hi = np.minimum(place + length, words.first[doc + 1])
                short = (words.hash >> np.uint64(32)).astype(np.uint32)
                data = [short[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), batch.column(0).take(pa.array(doc + part.start)), pa.array((lo - words.first[doc]).astype(np.int32)), pa.array(data, pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "seed long, doc_id long, place int, words binary")


def _around_hot(words: Words, k: int, length: int, hot: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the passages of `length` words that hold a hot seed."""
    g, place = _winnowed(words, k, length - k + 1)
    place = place[among(*hot, g)]
    doc = words.doc[place]
    lo, hi = np.maximum(place - (length - k), words.first[doc]), np.minimum(place, words.first[doc + 1] - length) + 1
    change = np.zeros(len(words.hash) + 1, np.int64)
    good = hi > lo
    np.add.at(change, lo[good], 1)
    np.add.at(change, hi[good], -1)
    start = np.flatnonzero(np.cumsum(change[:-1]))
    return gram_hashes(words.hash, length)[start] if len(start) else np.zeros(0, np.uint64), start


def _hot_passages(docs: DataFrame, k: int, length: int, shared) -> DataFrame:
    """(doc_id, begin, end) of the passages around hot seeds that several documents have."""

    def around(words: Words) -> tuple[np.ndarray, np.ndarray]:
        return _around_hot(words, k, length, shared.value[1])

    several = materialise(_spread(docs, around).select(F.col("hash").alias("known")), "passages")
    schema = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch, 1):
                words = Words(texts)
                g, start = around(words)
                doc = words.doc[start] if len(start) else start
                begin = (start - words.first[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), batch.column(0).take(pa.array(doc + part.start)), pa.array(begin), pa.array(begin + np.int32(length))], schema=schema)

    found = docs.select("doc_id", "text").mapInArrow(tidy(run), "hash long, doc_id long, begin int, end int")
    return found.join(checked_broadcast(several, 16), F.col("hash") == F.col("known"), "left_semi").select("doc_id", "begin", "end")


def _passages(strings: list[bytes], docs: list[np.ndarray], length: int, folder: str | None) -> list[np.ndarray]:
    """Of each string, the places at which a passage starts that another document has too; docs: of each string, the documents that have it whole."""
    import pandas as pd

    size = np.array([len(s) // 4 for s in strings])
    start = np.concatenate(([0], np.cumsum(size)))
    number, _ = pd.factorize(np.frombuffer(b"".join(strings), np.uint32), sort=True)
    string, left, lcp, _ = collection(number + 1, start, folder if len(number) > IN_MEMORY else None)
    group = np.cumsum(lcp < length)
    low, high = np.array([d.min() for d in docs])[string], np.array([d.max() for d in docs])[string]
    first = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
    many = np.repeat(np.minimum.reduceat(low, first) != np.maximum.reduceat(high, first), np.diff(np.append(first, len(group))))
    hit = np.flatnonzero(many & (left >= length))
    out: list[list[int]] = [[] for _ in strings]
    for s, place in zip(string[hit].tolist(), (size[string[hit]] - left[hit]).tolist()):
        out[s].append(place)
    return [np.sort(np.array(x, np.int64)) for x in out]


def _by_seed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """(seed, documents, places, words) of each seed, from batches in the order of seeds."""
    last, ids, at, words = None, [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, own, place = (batch.column(i).to_numpy() for i in range(3))
        text = batch.column(3).to_pylist()
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).tolist()
        for lo, hi in zip(new, [*new[1:], len(key)]):
            if key[lo] != last:
                if words:
                    yield last, np.concatenate(ids), np.concatenate(at), words
                last, ids, at, words = int(key[lo]), [], [], []
            ids.append(own[lo:hi])
            at.append(place[lo:hi])
            words += text[lo:hi]
    if words:
        yield last, np.concatenate(ids), np.concatenate(at), words


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, begin, end): maximal runs of words each of which is in a passage of `length` words that another document has too.

    Places count words from 0; end is the place after the last.  Words are
    runs of letters, marks and digits in lower case.  A passage that a document
    repeats in itself doesn't count, nor do rows that repeat an id: they are
    one document.  Rows without an id, and null, empty or shorter texts have no
    passages; texts of any length are read whole; of equal strings all places
    are found.  An empty table gives none; other columns are not looked at.
    """
    if not 0 < seed <= length:
        raise ValueError("a seed must have between 1 and length words")
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    spark = docs.sparkSession
    counted = materialise(_spread(docs, lambda words: _winnowed(words, seed, length - seed + 1)).select("hash", "n"), "seeds")
    hot = counted.filter(F.col("n") > HOT)
    any_hot = not hot.isEmpty()
    shared = spark.sparkContext.broadcast((bitmap(counted), bitmap(hot)))
    discard(counted)
    folder = shared_dir(spark)
    local = folder.removeprefix("file://") if folder.startswith(("file://", "/")) else None
    schema = pa.schema([("doc_id", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple[bytes, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            out: list[list[np.ndarray]] = [[], [], []]
            work = f"{local}/bwt-{uuid.uuid4().hex}" if local else None
            for places, (_, ids, at) in zip(_passages([r[0] for r in rows], [r[1] for r in rows], length, work), rows):
                if len(places):
                    edge = np.flatnonzero(np.diff(places) > 1)
                    a, b = places[np.concatenate(([0], edge + 1))], places[np.append(edge, len(places) - 1)] + length
                    out[0].append(np.repeat(ids, len(a)))
                    out[1].append((at[:, None] + a[None, :]).ravel())
                    out[2].append((at[:, None] + b[None, :]).ravel())
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(out, (np.int64, np.int32, np.int32))], schema=schema)

        rows: list[tuple[bytes, np.ndarray, np.ndarray]] = []
        total = 0
        for key, ids, at, words in _by_seed(batches):
            if len(ids) < 2 or ids.min() == ids.max():
                continue
            # places with the very same words around them are one string
            same: dict[bytes, list[int]] = {}
            for i, w in enumerate(words):
                same.setdefault(w, []).append(i)
            for w, members in same.items():
                rows.append((w, ids[members], at[members]))
                total += len(w) // 4
            if total > COLLECTION:
                yield from flush(rows)
                rows, total = [], 0
        yield from flush(rows)

    found = _strings(docs, seed, length, shared).repartition("seed").sortWithinPartitions("seed").mapInArrow(tidy(run), "doc_id long, begin int, end int")
    if any_hot:
        found = found.union(_hot_passages(docs, seed, length, shared))
    found = found.distinct()
    order = W.partitionBy("doc_id").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    step = F.when(before.isNull() | (F.col("begin") > before), 1).otherwise(0)
    runs = found.withColumn("step", step).withColumn("run", F.sum("step").over(order))
    return runs.groupBy("doc_id", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("run")
