"""N-gram Jaccard join: the grouped prefix join.

A document is the set of its word n-grams.  Under one global order of
n-grams, rare ones first, two sets of similarity t or more share an n-gram
among their first n - ceil(t n) + 1.  Documents with the same prefix and the
same size form one group; group pairs are filtered by size and by how many
n-grams their prefixes share, then expanded into members and verified exactly.

Documents with one and the same set are a class, which the one of lowest id
represents while pairs are sought.  `similar` gives the verified pairs of
representatives and pairs each copy with its own; `classes` gives one row per
document with its class, what it hangs together with and the number of other
classes it is similar to, counted where the pairs are verified.

The order only has to be the same for all documents, so frequencies need not
be exact: an n-gram ranks by the logarithm of its counts in those windows of
the scan where it comes up a handful of times, and all others rank first, by
hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, checked_broadcast, discard, groups, hang_together, keep_ids, materialise, tidy
from docloom.llm.textvec import Words, gram_hashes, mix, text_parts

N = 3
THRESHOLD = 0.7
#: Count in one window of the scan from which an n-gram is ranked by frequency.
FREQUENT = 4
#: Ranked n-grams that are sent to the scan; with more, the least frequent rank by hash alone. Affects speed only.
MOST_RANKED = 4_000_000
_WINDOW_CHARS = 32_000_000
_PAIR_BLOCK = 500_000
#: Pairs that are verified in one place; those of a larger crowd are spread by both of their documents.
_CROWD = 200_000


def sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram hash) of each distinct n-gram of each text, sorted; a text shorter than n words is one n-gram."""
    words = Words(texts)
    g, place = words.grams(n)
    doc = words.doc[place]
    count = words.counts()
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        g = np.concatenate([g, [gram_hashes(words.of(i), int(count[i]))[0] ^ np.uint64(count[i]) for i in short]]).astype(np.uint64)
        doc = np.concatenate([doc, short])
    by = np.lexsort((g, doc))
    g, doc = g[by], doc[by]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], g[keep]


def _scan(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, int]]:
    for batch in batches:
        for part, texts in text_parts(batch, 1):
            doc, g = sets(texts, n)
            yield batch.column(0).slice(part.start, len(texts)), doc, g, sum(map(len, texts))


def frequent(docs: DataFrame, n: int) -> DataFrame:
    """(gram, level): n-grams that are frequent in some window of the scan, and the logarithm of their count in all such."""
    schema = pa.schema([("gram", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            g, c = np.unique(np.concatenate(held), return_counts=True)
            g, c = g[c >= FREQUENT], c[c >= FREQUENT]
            return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c)], schema=schema)

        held, size = [], 0
        for _, _, g, chars in _scan(batches, n):
            held.append(g)
            size += chars
            if size >= _WINDOW_CHARS:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(tidy(run), "gram long, times long").groupBy("gram").agg(F.log2(F.sum("times")).cast("int").alias("level"))


class _Order:
    def __init__(self, gram: np.ndarray, level: np.ndarray):
        by = np.argsort(gram)
        self.gram, self.level = gram[by], level[by]
        self.bitmap = np.zeros(1 << 24, bool)
        self.bitmap[self.gram >> np.uint64(40)] = True

    def of(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(g), np.int32)
        if len(self.gram):
            maybe = np.flatnonzero(self.bitmap[g >> np.uint64(40)])
            at = np.minimum(np.searchsorted(self.gram, g[maybe]), len(self.gram) - 1)
            out[maybe] = np.where(self.gram[at] == g[maybe], self.level[at], 0)
        return out


def _order(docs: DataFrame, n: int):
    ranked = materialise(frequent(docs, n), "ranks")
    levels = sorted(((r[0], r[1]) for r in ranked.groupBy("level").count().collect()), reverse=True)
    least, total = 99, 0
    for level, count in levels:
        if total + count > MOST_RANKED:
            break
        least, total = level, total + count
    table = ranked.filter(F.col("level") >= least).toArrow()
    order = _Order(table.column("gram").to_numpy().view(np.uint64), table.column("level").to_numpy())
    return docs.sparkSession.sparkContext.broadcast(order)


def _prefixes(doc: np.ndarray, g: np.ndarray, order: _Order, threshold: float):
    """In the global order: gram, text, size, and whether it is of the prefix; and first row and size of each text."""
    by = np.lexsort((g, order.of(g), doc))
    doc, g = doc[by], g[by]
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(doc)))
    place = np.arange(len(doc)) - np.repeat(first, size)
    keep = place < np.repeat(prefix_length(size, threshold), size)
    return g, doc, np.repeat(size, size), keep, first, size


def least_overlap(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    return size - least_overlap(size, threshold) + 1


def signatures(docs: DataFrame, n: int, threshold: float, shared) -> DataFrame:
    """(doc_id, n, set1, set2, prefix): hashes of the whole set and of the prefix."""
    names = ["doc_id", "n", "set1", "set2", "prefix"]
    schema = pa.schema([(x, pa.int64()) for x in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, doc, g, _ in _scan(batches, n):
            g, doc, _, keep, first, size = _prefixes(doc, g, shared.value, threshold)
            if not len(first):
                continue
            set1, set2 = np.add.reduceat(mix(g), first), np.add.reduceat(mix(g ^ np.uint64(0xA5A5A5A5)), first)
            prefix = np.add.reduceat(np.where(keep, mix(g + np.uint64(77)), np.uint64(0)), first)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[first])), pa.array(size.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in (set1, set2, prefix))], schema=schema)

    return docs.mapInArrow(tidy(run), ", ".join(f"{x} long" for x in names))


_POSTING = (6, 8, 4, 4, 6, 2)
_PAIR = (8, 8, 4, 4)
#: More than any two sets share.
_NEVER = 1 << 30


def _planes(a: np.ndarray, n: int) -> bytes:
    """The n lower bytes of each number, all first bytes first: those that are all alike compress well."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _from_planes(data: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((data.size // n, 8), np.uint8)
    out[:, :n] = data.reshape(n, -1).T
    return out.view("<u8").ravel()


def _packed(slot: np.ndarray, columns: tuple[np.ndarray, ...], widths: tuple[int, ...], schema: pa.Schema) -> pa.RecordBatch:
    """One row for each slot, with the columns of its rows in so many bytes each."""
    by = np.argsort(slot, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(slot[by]) != 0))) if len(by) else np.zeros(0, np.int64)
    data = [b"".join(_planes(c[some], k) for c, k in zip(columns, widths)) for some in np.split(by, first[1:])] if len(first) else []
    return pa.RecordBatch.from_arrays([pa.array(slot[by][first].astype(np.int32)), pa.array(data, pa.binary())], schema=schema)


def _unpacked(rows: pa.ChunkedArray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """The columns of all rows."""
    out: list[list[np.ndarray]] = [[] for _ in widths]
    for chunk in rows.chunks:
        for blob in chunk:
            data = np.frombuffer(blob.as_buffer(), np.uint8)
            m, at = len(data) // sum(widths), 0
            for column, k in zip(out, widths):
                column.append(_from_planes(data[at : at + k * m], k))
                at += k * m
    return [np.concatenate(c).view(np.int64) for c in out]


def _prefix_rows(docs: DataFrame, n: int, threshold: float, shared) -> DataFrame:
    """(bucket, rows): the prefix n-grams (upper 48 bits, document, size, place in the order, n-gram before, 16 bits of that after) of a block of texts, one row for each bucket of n-grams."""
    schema = pa.schema([("bucket", pa.int32()), ("rows", pa.binary())])
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, doc, g, _ in _scan(batches, n):
            g, doc, size, keep, first, whole = _prefixes(doc, g, shared.value, threshold)
            place = np.arange(len(g)) - np.repeat(first, whole)
            g, size, doc, place = g[keep], size[keep], doc[keep], place[keep]
            gram = g >> np.uint64(16)
            before, after = np.zeros_like(gram), np.zeros_like(gram)
            same = doc[1:] == doc[:-1]
            before[1:] = np.where(same, gram[:-1], 0)
            after[:-1] = np.where(same, gram[1:] % np.uint64(65535) + np.uint64(1), 0)
            yield _packed((g % np.uint64(buckets)).astype(np.int32), (gram, ids.to_numpy()[doc], size, place, before, after), _POSTING, schema)

    return docs.mapInArrow(tidy(run), "bucket int, rows binary")


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def _folded(code: np.ndarray, shared: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each code once, with the sum of what is shared and the least of what is needed."""
    by = np.argsort(code)
    code = code[by]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[first], np.add.reduceat(shared[by], first), np.minimum.reduceat(need[by], first)


def _told(rows: DataFrame, threshold: float) -> DataFrame:
    """(slot, pairs): of pairs of groups whose sizes allow the similarity, how many prefix n-grams they share in one place, and how many they need.

    What two sets share lies in both prefixes or in the rest of one of them, so
    it is at most what the prefixes share and the longer rest.  Each bucket
    tells how many prefix n-grams of its own a pair shares; the sum decides.
    Of n-grams that follow each other in both prefixes only the first is told,
    and a pair that shares two in a row is a candidate: near copies share long
    rows, which would cross the network once for each n-gram of each pair.
    After the first n-gram that a pair shares both must have as many left as
    they need; a pair of which no place tells that is none.
    """
    schema = pa.schema([("slot", pa.int32()), ("pairs", pa.binary())])
    slots = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        gram, ident, size, place, before, after = _unpacked(table.column(1), _POSTING)
        del table
        by = np.lexsort((size, gram))
        gram, size, before, after = gram[by], size[by], before[by], after[by].astype(np.uint16)
        left_over = size - place[by]  # of the n-gram and those after it
        names, ident = np.unique(ident[by], return_inverse=True)
        # partners of a row: later rows of its n-gram that are not too large
        start = np.searchsorted(gram, gram, side="left")
        span = int(size.max()) + 2
        limit = np.minimum(np.floor(size / threshold + 1e-9).astype(np.int64), span - 1)
        far = np.minimum(np.searchsorted(gram, gram, side="right"), np.searchsorted(start * span + size, start * span + limit, side="right"))
        count = np.maximum(0, far - np.arange(len(gram)) - 1)
        rest = size - prefix_length(size, threshold)
        del gram, start, limit, far
        rows_with = np.flatnonzero(count)
        total = np.cumsum(count[rows_with])

        def out(code: np.ndarray, shared: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
            a, b = (names[x].view(np.uint64) for x in divmod(code, len(names)))
            slot = mix(mix(a) + (b & np.uint64(15))) % np.uint64(slots)
            return _packed(slot.astype(np.int32), (a, b, shared, need), _PAIR, schema)

        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = held = 0
        while at < len(rows_with):
            base = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, base + _PAIR_BLOCK, side="right")))
            some = count[rows_with[at:stop]]
            left = np.repeat(rows_with[at:stop], some)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(some) - some, some)
            ok = (ident[left] != ident[right]) & ((before[left] != before[right]) | (before[left] == 0))
            left, right = left[ok], right[ok]
            overlap = np.ceil(threshold / (1 + threshold) * (size[left] + size[right]) - 1e-9).astype(np.int64)
            need = np.maximum(1, overlap - np.maximum(rest[left], rest[right]))
            x, y = ident[left], ident[right]
            row = (after[left] == after[right]) & (after[left] != 0)
            found.append(_folded(np.minimum(x, y) * len(names) + np.maximum(x, y), np.where(row, need, 1), np.where(np.minimum(left_over[left], left_over[right]) < overlap, _NEVER, need))) if len(x) else None
            held += len(found[-1][0]) if len(x) else 0
            at = stop
            if held > 4 * _PAIR_BLOCK:
                found = [_folded(*map(np.concatenate, zip(*found)))]
                held = len(found[0][0])
                if held > 2 * _PAIR_BLOCK:
                    yield out(*found[0])
                    found, held = [], 0
        if found:
            yield out(*_folded(*map(np.concatenate, zip(*found))))

    return rows.repartition("bucket").mapInArrow(tidy(run), "slot int, pairs binary")


def _candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of groups whose sizes allow the similarity and whose prefixes share enough n-grams for it."""

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        a, b, shared, need = _unpacked(table.column(1), _PAIR)
        by = np.lexsort((b, a))
        a, b = a[by], b[by]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        first = first[np.add.reduceat(shared[by], first) >= np.minimum.reduceat(need[by], first)]
        yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], names=["a", "b"])

    return _told(rows, threshold).repartition("slot").mapInArrow(tidy(enough), "a long, b long")


def _bring(docs: DataFrame, pairs: DataFrame, reps: DataFrame, n: int, threshold: float, emit, kind: str) -> tuple[DataFrame, list[DataFrame]]:
    """What emit makes of the pairs in each place, and the written tables that it is read from.

    Pairs that hang together are brought to one place with one copy of each
    document's set, rather than a copy for each pair.
    """
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    least = materialise(ends.groupBy("id").agg(F.least(F.min("id"), F.min("other")).alias("lead")), "leads")
    side = checked_broadcast(least, 24)
    placed = pairs.join(side.select(F.col("id").alias("a"), F.col("lead").alias("la")), "a").join(side.select(F.col("id").alias("b"), F.col("lead").alias("lb")), "b")
    placed = materialise(placed.select("a", "b", F.least("la", "lb").alias("lead")), "placed")
    crowd = materialise(placed.groupBy("lead").count().filter(F.col("count") > _CROWD).select(F.col("lead").alias("crowd"), F.ceil(F.col("count") / _CROWD).alias("parts")), "crowds")
    placed = placed.join(checked_broadcast(crowd, 24), F.col("lead") == F.col("crowd"), "left")
    # the cells of a triangle, so that each set goes to one row of them only
    side_of = [F.pmod(F.xxhash64(end), F.coalesce(F.ceil(F.sqrt(2 * F.col("parts"))), F.lit(1))) for end in "ab"]
    placed = placed.select("a", "b", F.xxhash64("lead", F.least(*side_of), F.greatest(*side_of)).alias("spot"))
    own = checked_broadcast(least, 24).join(reps.select(F.col("rep").alias("id"), F.col("set1").alias("name")), "id").select("id", "name")
    own = materialise(own, "own")
    wanted = placed.select(F.col("a").alias("id"), "spot").union(placed.select("b", "spot")).distinct()
    wanted = materialise(wanted.join(checked_broadcast(own, 32), "id"), "wanted")

    schema = pa.schema([("id", pa.int64()), ("name", pa.int64()), ("grams", pa.binary())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, doc, g, _ in _scan(batches, n):
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
            names = np.add.reduceat(mix(g), first) if len(first) else g
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[first])), pa.array(names.view(np.int64)), pa.array([_six_bytes(x) for x in np.split(g, first[1:])] if len(first) else [], pa.binary())], schema=schema)

    some = keep_ids(docs, least.select(F.col("id").alias("doc_id")), "left_semi").select("doc_id", "text")
    held = some.mapInArrow(tidy(packed), "id long, name long, grams binary").join(checked_broadcast(wanted, 32), ["id", "name"]).select("spot", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "name", "grams")
    both = held.unionByName(placed.select("spot", "a", "b", F.lit(None).cast("long").alias("name"), F.lit(None).cast("binary").alias("grams"))).repartition("spot")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        is_set = table.column("b").is_null().to_numpy()
        spot, a, b = table.column("spot").to_numpy(), table.column("a").to_numpy(), pc.fill_null(table.column("b"), 0).to_numpy()
        # each set once in each spot, whatever rows repeat
        which = np.flatnonzero(is_set)
        sets_ = table.select(["name", "grams"]).take(pa.array(which))
        name = sets_.column("name").to_numpy()
        by = np.lexsort((name, a[which], spot[which]))
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(spot[which][by]) != 0) | (np.diff(a[which][by]) != 0) | (np.diff(name[by]) != 0)
        by = by[new]
        if not len(by) or is_set.all():
            return
        key = _key(spot[which][by], a[which][by])
        blobs = sets_.column("grams").take(pa.array(by)).to_pylist()
        name, owner = name[by], a[which][by]
        x, y = _key(spot[~is_set], a[~is_set]), _key(spot[~is_set], b[~is_set])
        del table, sets_
        order = np.argsort(key, kind="stable")
        ranges = [(np.searchsorted(key[order], z, "left"), np.searchsorted(key[order], z, "right")) for z in (x, y)]
        times = [hi - lo for lo, hi in ranges]
        left, right = _cross(ranges[0][0], times[0], ranges[1][0], times[1])
        left, right = order[left], order[right]
        twice = (owner[left] == owner[right]) & (left >= right)
        left, right = left[~twice], right[~twice]
        by = np.lexsort((right, left))
        left, right = left[by], right[by]
        value = _jaccard(left, right, blobs)
        ok = value >= threshold - 1e-12
        yield from emit(owner, name, left[ok], right[ok], value[ok])

    return both.mapInArrow(tidy(verify), kind), [least, crowd, own, wanted]


def _key(spot: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """A document in its place, as one number."""
    return mix(mix(spot.astype(np.int64).view(np.uint64)) + ident.astype(np.int64).view(np.uint64))


def _cross(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row all combinations of a number from a to a + m with one from b to b + n."""
    total = m * n
    row = np.repeat(np.arange(len(total)), total)
    step = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
    return a[row] + step // n[row], b[row] + step % n[row]


def _six_bytes(g: np.ndarray) -> bytes:
    """The upper 48 bits of each hash."""
    return (g >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _jaccard(left: np.ndarray, right: np.ndarray, blobs: list[bytes]) -> np.ndarray:
    """Similarity of each pair of sets, which come ordered by the first."""
    import pandas as pd

    size = np.array([len(x) // 6 for x in blobs])
    start = np.concatenate(([0], np.cumsum(size)))
    wide = np.zeros((int(start[-1]), 8), np.uint8)
    wide[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    flat, uniques = pd.factorize(wide.view("<u8").ravel())
    del wide
    flat = flat.astype(np.int32)
    mark = np.zeros(len(uniques), bool)
    out = np.zeros(len(left))
    heads = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1]))) if len(left) else np.zeros(0, np.int64)
    for lo, hi in zip(heads, np.append(heads[1:], len(left))):
        k = left[lo]
        own = flat[start[k] : start[k + 1]]
        mark[own] = True
        for at in range(lo, hi, 500):
            other = right[at : min(hi, at + 500)]
            cells = np.concatenate([flat[start[o] : start[o + 1]] for o in other])
            common = np.add.reduceat(mark[cells], np.concatenate(([0], np.cumsum(size[other])[:-1])), dtype=np.int64)
            out[at : at + len(other)] = common / (size[k] + size[other] - common)
        mark[own] = False
    return out


def _as_pairs(owner: np.ndarray, name: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (owner[left], owner[right], value)], names=["a", "b", "jaccard"])


def _as_sums(owner: np.ndarray, name: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, name, links, near): of each set the number of its partners in this place, and the least document of all that hang together here."""
    if len(left):
        links = np.bincount(left, minlength=len(owner)) + np.bincount(right, minlength=len(owner))
        least, here = hang_together(owner, left, right), np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(c[here]) for c in (owner, name, links, least)], names=["id", "name", "links", "near"])


def _sets(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs as they are read; signatures; (n, set1, set2, prefix, rep, copies) of each set; and the pairs of representatives that may be similar."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    shared = _order(docs, n)
    sig = materialise(signatures(docs, n, threshold, shared).distinct(), "signatures")
    reps = materialise(sig.groupBy("n", "set1", "set2", "prefix").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "sets")
    heads = reps.groupBy("n", "prefix").agg(F.min("rep").alias("head"), F.count("*").alias("members"))
    heads = materialise(heads, "groups")
    silent = sig.select("doc_id").distinct().join(heads.select(F.col("head").alias("doc_id")), "doc_id", "left_anti")
    rows = _prefix_rows(keep_ids(docs, silent, "left_anti").select("doc_id", "text"), n, threshold, shared)
    between = materialise(_candidates(rows, threshold), "between")
    # groups of several sets; all others are their only member
    crowd = heads.filter("members > 1").select("n", "prefix", "head")
    crowd = materialise(reps.join(checked_broadcast(crowd, 32), ["n", "prefix"]).select("head", "rep"), "members")
    side = checked_broadcast(crowd, 24)
    inside = crowd.withColumnRenamed("rep", "a").join(side.withColumnRenamed("rep", "b"), "head").filter("a < b").select("a", "b")
    across = between
    for end in "ab":
        across = across.join(side.select(F.col("head").alias(end), F.col("rep").alias(f"r{end}")), end, "left").withColumn(end, F.coalesce(f"r{end}", end)).drop(f"r{end}")
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")
    both = reps.groupBy("rep").count().filter("count > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))  # two sets of one id
    pairs = materialise((between if crowd.isEmpty() else inside.union(across).distinct()).select("a", "b").union(both), "candidates")
    discard(between, crowd, heads)
    return docs, sig, reps, pairs


def similar(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: similar pairs of representatives, and each other document of a class with its representative.

    Of documents with equal n-gram sets the lowest id is compared with others,
    and the rest are paired with it, at 1.0.  Rows without an id or without
    words are in no pair; a text of fewer than n words is one n-gram; rows
    that repeat an id with other texts count as one document whose pairs are
    those of any of its texts.  An empty table gives no pairs; other columns
    are not looked at.
    """
    docs, sig, reps, pairs = _sets(docs, n, threshold)
    found, _ = _bring(docs, pairs, reps, n, threshold, _as_pairs, "a long, b long, jaccard double")
    many = reps.filter("copies > 1").drop("copies", "prefix")
    copies = sig.join(many, ["n", "set1", "set2"]).filter("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    found = found.filter("a <> b").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "jaccard")
    return copies.union(found).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, set_id, copies, links): one row for each document that is similar to another one.

    set_id is the lowest id of the documents with the same n-gram set, copies
    their number, links the number of other sets that are similar to it, and
    class_id the lowest id of all documents that hang together by equal or
    similar sets.  An id that repeats with other texts is one document: it has
    the lowest set_id and the sum of the copies and links of its texts.  Rows
    without an id or without words are similar to none; a text of fewer than n
    words is one n-gram, and one of any length is taken whole; a similarity
    that equals the threshold counts; ties go to the lowest id.  An empty table gives no
    rows; other columns are not looked at.
    """
    docs, sig, reps, pairs = _sets(docs, n, threshold)
    found, used = _bring(docs, pairs, reps, n, threshold, _as_sums, "id long, name long, links long, near long")
    found = materialise(found, "links")
    discard(pairs, *used)
    linked = found.groupBy("id", "name").agg(F.sum("links").alias("links"))
    linked = materialise(linked.select(F.col("id").alias("rep"), F.col("name").alias("set1"), "links"), "linked")
    of = reps.join(checked_broadcast(linked, 32), ["rep", "set1"], "left").filter("copies > 1 OR links > 0")
    of = materialise(of.select("n", "set1", "set2", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links")), "sets-linked")
    member = materialise(sig.join(checked_broadcast(of, 56), ["n", "set1", "set2"]).select("doc_id", "rep", "copies", "links"), "members")
    out = member.groupBy("doc_id").agg(F.min("rep").alias("set_id"), F.sum("copies").alias("copies"), F.sum("links").alias("links"), F.max("rep").alias("last"))
    out = materialise(out, "similar")
    several = member.join(out.filter("set_id <> last").select("doc_id"), "doc_id", "left_semi")
    edges = found.select(F.col("id").alias("doc_a"), F.col("near").alias("doc_b")).union(several.select("doc_id", "rep"))
    group = groups(edges.filter("doc_a <> doc_b"))
    discard(sig, reps, linked, of, found, member)
    out = out.join(checked_broadcast(group, 24).withColumnRenamed("doc_id", "set_id"), "set_id", "left")
    return out.select("doc_id", F.coalesce("group", "set_id").alias("class_id"), "set_id", "copies", "links")


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document, that of lowest id, of each group of similar ones; all columns stay.

    Rows without an id or words stay.  Repeated rows of one id become one row.
    """
    drop = materialise(classes(docs, n, threshold).filter("doc_id <> class_id").select("doc_id"), "copies")
    kept = keep_ids(docs, drop, "left_anti").select(docs.columns)
    twice = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id")
    twice = materialise(twice, "repeated")
    if twice.isEmpty():
        return kept
    once = keep_ids(kept, twice, "left_anti").select(docs.columns)
    return once.unionByName(keep_ids(kept, twice, "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))
