"""Benchmark decontamination: greedy string tiling.

Every run of `min_tile` words of a benchmark item is a seed.  Documents that
hold a seed meet that item; the pair is then tiled: the longest matching run
of unmarked words is marked again and again until none of min_tile words is
left, so a passage that was cut up and reordered is still covered.  An item
whose words are tiled to at least `threshold` has leaked into the document.

Runs are found by Karp-Rabin hashes of the words and confirmed word by word.
While the benchmark fits the broadcast limit, its seeds travel to the scan of
the documents and nothing is shuffled; beyond it, document seeds that pass a
Bloom filter are joined with the benchmark's and only documents that met an
item are read again.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_BYTES, among, bitmap, bounded_batches, checked_broadcast, keep_ids, materialise, tidy
from docloom.llm.textvec import Words, gram_hashes, text_parts

MIN_TILE = 5
THRESHOLD = 0.5
_OUT = "doc_id long, item_id long, coverage double, tiles int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32())])
_BITS = 24


def tiles(doc: np.ndarray, item: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of each tile.

    The longest match goes first; of equals, the one that starts first in the
    item, then in the document.
    """
    gi, gd = gram_hashes(item, min_tile), gram_hashes(doc, min_tile)
    if not len(gi) or not len(gd):
        return []
    order = np.argsort(gi, kind="stable")
    sorted_gi = gi[order]
    lo, hi = np.searchsorted(sorted_gi, gd, "left"), np.searchsorted(sorted_gi, gd, "right")
    n = hi - lo
    if not n.any():
        return []
    d = np.repeat(np.arange(len(gd)), n)
    i = order[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(d))]
    diagonal = d - i
    by = np.lexsort((i, diagonal))
    d, i, diagonal = d[by], i[by], diagonal[by]
    new = np.flatnonzero(np.concatenate(([True], (diagonal[1:] != diagonal[:-1]) | (i[1:] != i[:-1] + 1))))
    length = np.diff(np.append(new, len(i))) + min_tile - 1
    heap = []
    for a, b, k in zip(i[new].tolist(), d[new].tolist(), length.tolist()):
        same = item[a : a + k] == doc[b : b + k]
        if same.all():
            heap.append((-k, a, b))
        else:  # the hash lied somewhere: keep the runs that do agree
            edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
            heap += [(-(y - x), a + x, b + x) for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist()) if y - x >= min_tile]
    heapq.heapify(heap)
    in_item, in_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        k, a, b = heapq.heappop(heap)
        k = -k
        free = ~(in_item[a : a + k] | in_doc[b : b + k])
        if free.all():
            in_item[a : a + k] = in_doc[b : b + k] = True
            out.append((a, b, k))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist()):
            if y - x >= min_tile:
                heapq.heappush(heap, (-(y - x), a + x, b + x))
    return out


class _Seeds:
    """The benchmark's seeds in a form that a scan can test quickly."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], min_tile: int):
        self.items, self.min_tile = items, min_tile
        grams = [gram_hashes(h, min(min_tile, len(h))) for _, h in items]
        owner = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        seed = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        by = np.argsort(seed, kind="stable")
        self.seed, self.owner = seed[by], owner[by]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self.seed >> np.uint64(64 - _BITS)] = True

    def meet(self, words: Words) -> list[tuple[int, int]]:
        """(text, item) pairs that share a seed."""
        g, place = words.grams(self.min_tile)
        maybe = np.flatnonzero(self.bitmap[g >> np.uint64(64 - _BITS)])
        g, place = g[maybe], place[maybe]
        lo, hi = np.searchsorted(self.seed, g, "left"), np.searchsorted(self.seed, g, "right")
        n = hi - lo
        doc = np.repeat(words.doc[place], n)
        item = self.owner[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(doc))] if len(doc) else doc
        pairs = np.unique(doc * max(1, len(self.items)) + item)
        return [(int(p) // len(self.items), int(p) % len(self.items)) for p in pairs]


def cover(doc: np.ndarray, item: np.ndarray, min_tile: int) -> tuple[float, int]:
    found = tiles(doc, item, min_tile)
    return sum(k for _, _, k in found) / len(item), len(found)


def _scan(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: _Seeds = shared.value
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for part, texts in text_parts(batch, 1):
                words = Words(texts)
                for t, i in seeds.meet(words):
                    item_id, item = seeds.items[i]
                    share, count = cover(words.of(t), item, seeds.min_tile)
                    if share >= threshold:
                        rows.append((ids[part.start + t], item_id, share, count))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, _ARROW.types)], schema=_ARROW)

    return run


def _items(rows, min_tile: int) -> list[tuple[int | None, np.ndarray]]:
    words = Words([r[1] for r in rows])
    return [(r[0], words.of(k).copy()) for k, r in enumerate(rows) if len(words.of(k)) >= min_tile]


def leaks(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, threshold: float = THRESHOLD, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, tiles) of each leaked item; coverage is the tiled share of the item's words.

    Null or empty texts have no words and never match; an item of fewer than
    min_tile words can't be found and is left out.  A null id stays null in
    the result.  Repeated rows give one row, that of the highest coverage and
    of equals the one of fewest tiles; all rows without an id count as one.
    Texts of any length are tiled whole.
    Either table may be empty, and other columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text").filter(F.length("text") > 0)
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).filter(F.length("item_text") > 0).distinct()
    spark = docs.sparkSession
    characters = benchmark.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0]
    if characters * 8 <= limit:
        shared = spark.sparkContext.broadcast(_Seeds(_items([tuple(r) for r in benchmark.collect()], min_tile), min_tile))
        found = docs.mapInArrow(tidy(_scan(shared, threshold)), _OUT)
    else:
        nameless = docs.filter("doc_id IS NULL")
        found = _joined(docs.filter("doc_id IS NOT NULL"), benchmark, min_tile, threshold)
        if not nameless.isEmpty():
            rows = materialise(nameless.select(F.monotonically_increasing_id().alias("doc_id"), "text"), "nameless")
            found = found.union(_joined(rows, benchmark, min_tile, threshold).withColumn("doc_id", F.lit(None).cast("long")))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", -F.col("tiles"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.coverage").alias("coverage"), (-F.col("best.col2")).cast("int").alias("tiles"))


def _seed_rows(min_tile: int, shared=None):
    schema = pa.schema([("id", pa.int64()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for part, texts in text_parts(batch, 1):
                words = Words(texts)
                g, place = words.grams(min_tile)
                doc = words.doc[place]
                if shared is not None:
                    keep = among(*shared.value, g)
                    g, doc = g[keep], doc[keep]
                if len(g):
                    by = np.lexsort((g, doc))
                    g, doc = g[by], doc[by]
                    new = np.concatenate(([True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[new] + part.start)), pa.array(g[new].view(np.int64))], schema=schema)

    return run


def _joined(docs: DataFrame, benchmark: DataFrame, min_tile: int, threshold: float) -> DataFrame:
    """The same result by joins, for a benchmark of any size and documents with ids."""
    spark = docs.sparkSession
    item_seed = materialise(benchmark.select("item_id", "item_text").mapInArrow(tidy(_seed_rows(min_tile)), "id long, hash long"), "item-seeds")
    shared = spark.sparkContext.broadcast(bitmap(item_seed))
    doc_seed = docs.select("doc_id", "text").mapInArrow(tidy(_seed_rows(min_tile, shared)), "id long, hash long").withColumnRenamed("id", "doc_id")
    pairs = doc_seed.join(item_seed.withColumnRenamed("id", "item_id"), "hash").select(F.col("doc_id").alias("__doc"), "item_id").distinct()
    pairs = materialise(pairs, "seed-pairs")
    side = keep_ids(docs, pairs.select(F.col("__doc").alias("doc_id")).distinct(), "left_semi")
    side = side.join(pairs, side["doc_id"] == pairs["__doc"]).drop("__doc")
    out = side.join(benchmark.withColumnRenamed("item_id", "__item"), F.col("item_id").eqNullSafe(F.col("__item"))).select("doc_id", "item_id", "text", "item_text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, items, texts, wanted = (c.to_pylist() for c in batch.columns)
            rows = []
            for k in range(len(ids)):
                words = Words([texts[k], wanted[k]])
                if len(words.of(1)) >= min_tile:
                    share, count = cover(words.of(0), words.of(1), min_tile)
                    if share >= threshold:
                        rows.append((ids[k], items[k], share, count))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, _ARROW.types)], schema=_ARROW)

    return out.mapInArrow(tidy(check), _OUT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kwargs) -> DataFrame:
    """docs without those into which an item leaked; all columns stay.

    A row without an id is judged by itself; an id that repeats goes with all
    its rows if an item leaked into one of them.
    """
    bad = materialise(leaks(docs.filter("doc_id IS NOT NULL"), benchmark, **kwargs).select("doc_id").distinct(), "leaked")
    nameless = docs.filter("doc_id IS NULL")
    if nameless.isEmpty():
        return keep_ids(docs, bad, "left_anti").select(docs.columns)
    key = f"row_{uuid.uuid4().hex}"
    keyed = materialise(nameless.withColumn(key, F.monotonically_increasing_id()), "nameless")
    leaked = materialise(leaks(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, **kwargs).select(F.col("doc_id").alias("__row")).distinct(), "leaked-rows")
    leaked = checked_broadcast(leaked, 24)
    clean = keyed.join(leaked, keyed[key] == leaked["__row"], "left_anti").select(docs.columns)
    return keep_ids(docs.filter("doc_id IS NOT NULL"), bad, "left_anti").select(docs.columns).unionByName(clean)
