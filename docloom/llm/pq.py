"""Embedding near-duplicates: product quantisation.

Unit vectors are put into coarse inverted lists, about as many as the root of
their number, and what is left of each after its list's centre is coded by
subspaces.  Centres and codebooks come from Lloyd's rounds over all vectors;
only partial sums leave the scan.

Every vector is a query.  A neighbour within the radius that belongs to the
threshold lies in another list only if the query is close to the plane between
the two centres, so a query probes the lists whose plane is near enough; of two
lists only the one of higher number is probed.  In a list, table look-ups give
asymmetric distances to the codes, and with the coding error that each code
carries they leave few candidates, whose exact cosine decides.

How near is near enough follows from the spread of a random direction: SPREAD
standard deviations.  A neighbour that lies beyond is missed, which for
differences without a direction of their own is about one in ten thousand.

Equal vectors are searched for once.  Pairs are counted and joined into groups
where they are found and never leave that place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checked_broadcast, discard, groups, hang_together, materialise, tidy

THRESHOLD = 0.95
SUBSPACES = 8
CODES = 256
COARSE_ROUNDS, CODE_ROUNDS = 5, 4
MOST_LISTS = 1 << 16
SPREAD = 4.0
#: Members of a list that are searched by one task; longer lists are searched in parts.
PART = 20_000
_BLOCK = 4_000_000


def units(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """(id, v): the vectors at length 1 as float32 bytes, and their dimension, the most frequent one."""
    some = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("e")).filter("id IS NOT NULL AND e IS NOT NULL AND size(e) > 0")
    sizes = sorted((-r["count"], r["d"]) for r in some.groupBy(F.size("e").alias("d")).count().collect())
    if not sizes:
        return some.select("id", F.lit(None).cast("binary").alias("v")).filter("false"), 0
    dim = sizes[0][1]
    schema = pa.schema([("id", pa.int64()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            x = np.where(np.isnan(flat), np.inf, flat).reshape(-1, dim)
            with np.errstate(all="ignore"):
                x = x / np.abs(x).max(1, keepdims=True)  # else very large or small numbers overflow when squared
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
            good = np.isfinite(x).all(1)
            data = [r.tobytes() for r in x[good].astype(np.float32)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(data, pa.binary())], schema=schema)

    return materialise(some.filter(F.size("e") == dim).mapInArrow(tidy(run), "id long, v binary").distinct(), "units"), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre; of equals, the lowest."""
    half = (centres * centres).sum(1) / 2
    step = max(1, _BLOCK // max(1, len(centres)))
    return np.concatenate([np.argmax(x[i : i + step] @ centres.T - half, axis=1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def _lloyd(rows: DataFrame, dim: int, groups: Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]) -> dict[int, tuple[np.ndarray, int]]:
    """Sums and counts by group over all vectors; groups gives pairs of group numbers and vectors."""
    schema = pa.schema([("g", pa.int32()), ("s", pa.binary()), ("n", pa.int64())])

    def totals(table: dict[int, list], out_of: Iterator[tuple[int, np.ndarray, int]]) -> pa.RecordBatch:
        for g, s, n in out_of:
            if g in table:
                table[g][0] += s
                table[g][1] += n
            else:
                table[g] = [s.copy(), n]
        return pa.RecordBatch.from_arrays([pa.array(list(table), pa.int32()), pa.array([v[0].tobytes() for v in table.values()], pa.binary()), pa.array([v[1] for v in table.values()], pa.int64())], schema=schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                if batch.num_rows:
                    for g, x in groups(_matrix(batch.column(0), dim)):
                        by = np.argsort(g, kind="stable")
                        first = np.flatnonzero(np.concatenate(([True], np.diff(g[by]) != 0)))
                        sums = np.add.reduceat(x[by].astype(np.float64), first, axis=0)
                        yield from zip(g[by][first].tolist(), sums, np.diff(np.append(first, len(g))).tolist())

        yield totals({}, each())

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield totals({}, ((g, np.frombuffer(s, np.float64), n) for b in batches for g, s, n in zip(*(c.to_pylist() for c in b.columns))))

    kind = "g int, s binary, n long"
    return {r["g"]: (np.frombuffer(bytes(r["s"]), np.float64), r["n"]) for r in rows.select("v").mapInArrow(tidy(partial), kind).repartition("g").mapInArrow(tidy(combine), kind).toLocalIterator()}


class Index:
    """Centres of the lists and codebooks of the subspaces."""

    def __init__(self, rows: DataFrame, dim: int, count: int):
        k = int(min(MOST_LISTS, max(1, round(count**0.5)), count))
        first = rows.orderBy(F.xxhash64("id"), "id").limit(max(k, min(count, CODES))).select("v").toArrow()
        seed = _matrix(first.column(0), dim)
        self.dim, self.centres = dim, seed[:k].copy()
        spark = rows.sparkSession
        for _ in range(COARSE_ROUNDS):
            shared = spark.sparkContext.broadcast(self.centres)
            for g, (s, n) in _lloyd(rows, dim, lambda x: [(_nearest(x, shared.value), x)]).items():
                self.centres[g] = s / n
        m = min(SUBSPACES, dim)
        self.edges = np.linspace(0, dim, m + 1).astype(int)
        left = seed[: min(count, CODES)]
        left = left - self.centres[_nearest(left, self.centres)]
        self.books = [left[:, a:b].copy() for a, b in zip(self.edges, self.edges[1:])]
        for _ in range(CODE_ROUNDS):
            shared = spark.sparkContext.broadcast((self.centres, self.books, self.edges))

            def groups(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                centres, books, edges = shared.value
                left = x - centres[_nearest(x, centres)]
                for j, book in enumerate(books):
                    part = left[:, edges[j] : edges[j + 1]]
                    yield _nearest(part, book) + j * CODES, part

            for g, (s, n) in _lloyd(rows, dim, groups).items():
                self.books[g // CODES][g % CODES] = s / n

    def code(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the subspaces, and the length of what they leave out."""
        left = x - self.centres[lists]
        codes = np.stack([_nearest(left[:, a:b], book) for a, b, book in zip(self.edges, self.edges[1:], self.books)], axis=1).astype(np.uint8)
        known = np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)
        return codes, np.linalg.norm(left - known, axis=1)

    def probes(self, x: np.ndarray, own: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, list) of the lists that a query may have neighbours in: its own, and those of a higher number that are near enough."""
        norm = (self.centres * self.centres).sum(1)
        step = max(1, _BLOCK // len(self.centres))
        for i in range(0, len(x), step):
            some, mine = x[i : i + step], own[i : i + step]
            d = norm[None, :] - 2 * (some @ self.centres.T)  # squared distances, but for the query's own length
            gap = d - d[np.arange(len(some)), mine][:, None]
            apart = np.sqrt(np.maximum(0, norm[mine][:, None] + norm[None, :] - 2 * self.centres[mine] @ self.centres.T))
            near = (gap <= 2 * apart * reach + 1e-6) & (np.arange(len(self.centres))[None, :] > mine[:, None])
            near[np.arange(len(some)), mine] = True
            row, lists = np.nonzero(near)
            yield row + i, lists


def _search(index: Index, members: tuple, queries: tuple, number: int, radius: float, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, member, cosine) of the pairs within one list, by their places."""
    ids, codes, error, x = members
    q_ids, q_own, q = queries
    slack = min(1.0, SPREAD / index.dim**0.5)
    most = radius**2 + error**2 + 2 * radius * error * slack + 1e-5
    step = max(1, _BLOCK // max(1, len(ids)))
    for i in range(0, len(q), step):
        some = q[i : i + step]
        left = some - index.centres[number]
        d = np.zeros((len(some), len(ids)), np.float32)
        for j, (a, b, book) in enumerate(zip(index.edges, index.edges[1:], index.books)):
            part = left[:, a:b]
            table = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)[None, :]
            d += table[:, codes[:, j]]
        # in their common list each pair comes up twice
        ok = (d <= most[None, :]) & ((q_own[i : i + step] != number)[:, None] | (q_ids[i : i + step][:, None] < ids[None, :])) & (q_ids[i : i + step][:, None] != ids[None, :])
        row, col = np.nonzero(ok)
        for k in range(0, len(row), 200_000):
            r, c = row[k : k + 200_000], col[k : k + 200_000]
            cosine = (some[r].astype(np.float64) * x[c]).sum(1)
            good = cosine >= threshold - 1e-9
            yield i + r[good], c[good], cosine[good]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_a, vec_b, cosine), vec_a < vec_b: pairs of different vectors of cosine threshold or more, each by its lowest id.

    Vectors that are null, empty, zero or of another length than most, or that
    hold a null, a NaN or an infinity, are in no pair, nor is one without an
    id.  Rows that repeat count once; an id with several vectors has the pairs
    of each, at the highest cosine.  An empty table has no pairs; other
    columns are not looked at.
    """
    rows, dim = units(vectors, key, column)
    reps = materialise(rows.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), "vectors")
    found = _found(reps, dim, threshold, _as_pairs, "vec_a long, vec_b long, cosine double")
    return found.groupBy("vec_a", "vec_b").agg(F.round(F.max("cosine"), 4).alias("cosine"))


def classes(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, class_id, copies, links): one row for each id that has a vector to compare.

    copies is the number of ids with the same vector (at length 1), links the
    number of other vectors of cosine threshold or more, and class_id the
    lowest id of all that hang together by equal vectors or links.  Vectors
    that are null, empty, zero or of another length than most, or that hold a
    null, a NaN or an infinity, are not compared, nor is one without an id.
    Rows that repeat count once; an id with several vectors has the sums of
    theirs, and doesn't link to itself.  An empty table has no classes; other
    columns are not looked at.
    """
    rows, dim = units(vectors, key, column)
    reps = materialise(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "v", "copies"), "vectors")
    found = materialise(_found(reps.select("id", "v"), dim, threshold, _as_sums, "id long, links long, near long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    copied = reps.filter("copies > 1")
    if copied.isEmpty():
        of = rows.select("id", F.col("id").alias("rep"), F.lit(1).cast("long").alias("copies"))
    else:
        side = checked_broadcast(copied.select(F.col("id").alias("rep"), "v", "copies"), 16 + 4 * dim)
        of = rows.join(side, "v", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    of = of.join(checked_broadcast(links.withColumnRenamed("id", "rep"), 16), "rep", "left")
    out = materialise(of.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"), F.sum("copies").alias("copies"), F.coalesce(F.sum("links"), F.lit(0)).alias("links")), "similar")
    several = of.join(checked_broadcast(out.filter("rep <> last").select("id"), 8), "id", "left_semi")
    edges = found.select(F.col("id").alias("doc_a"), F.col("near").alias("doc_b")).union(several.select("id", "rep"))
    group = groups(edges.filter("doc_a <> doc_b"))
    discard(rows, reps, found)
    out = out.join(checked_broadcast(group, 16).withColumnRenamed("doc_id", "rep"), "rep", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("group", "rep").alias("class_id"), "copies", "links")


def _as_pairs(ids: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: np.ndarray) -> Iterator[pa.RecordBatch]:
    a, b = ids[a], ids[b]
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cosine)], names=["vec_a", "vec_b", "cosine"])


def _as_sums(ids: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, links, near): of each vector the number of its partners here, and the least id of all that hang together here."""
    links = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
    least, here = hang_together(ids, a, b), np.flatnonzero(links)
    yield pa.RecordBatch.from_arrays([pa.array(c[here]) for c in (ids, links, least)], names=["id", "links", "near"])


def _found(rows: DataFrame, dim: int, threshold: float, emit, kinds: str) -> DataFrame:
    """What emit makes of the pairs of each list, given as places in an array of ids."""
    spark = rows.sparkSession
    count = rows.count()
    if count < 2:
        return spark.createDataFrame([], kinds)
    index = Index(rows, dim, count)
    shared = spark.sparkContext.broadcast(index)
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    reach = radius * min(1.0, SPREAD / dim**0.5)
    coded = pa.schema([("list", pa.int32()), ("own", pa.int32()), ("id", pa.int64()), ("code", pa.binary()), ("error", pa.float32()), ("v", pa.binary())])
    kind = "list int, own int, id long, code binary, error float, v binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, data = batch.column(0).to_numpy(), batch.column(1)
            x = _matrix(data, dim)
            own = _nearest(x, ix.centres)
            codes, error = ix.code(x, own)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(ids), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.float32)), data], schema=coded)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _matrix(batch.column(2), dim), batch.column(0).to_numpy()
            for row, lists in ix.probes(x, own, reach):
                at = pa.array(row)
                none = pa.nulls(len(row))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at), none.cast(pa.binary()), none.cast(pa.float32()), batch.column(2).take(at)], schema=coded)

    members = materialise(rows.mapInArrow(tidy(encode), kind), "members")
    crowd = members.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("p")).filter("p > 1")
    crowd = checked_broadcast(materialise(crowd, "crowds").withColumnRenamed("list", "long_list"), 8)

    def parted(side: DataFrame) -> DataFrame:
        return side.join(crowd, F.col("list") == F.col("long_list"), "left").drop("long_list").withColumn("p", F.coalesce("p", F.lit(1)))

    queries = members.select("own", "id", "v").mapInArrow(tidy(probe), kind)
    own = parted(members).withColumn("part", F.pmod(F.xxhash64("id"), F.col("p")).cast("int")).drop("p")
    both = own.unionByName(parted(queries).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).drop("p"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        number, part = table.column("list").to_numpy(), table.column("part").to_numpy()
        is_query = table.column("code").is_null().to_numpy()
        by = np.lexsort((is_query, part, number))
        new = np.flatnonzero(np.concatenate(([True], (np.diff(number[by]) != 0) | (np.diff(part[by]) != 0))))
        for lo, hi in zip(new, np.append(new[1:], len(by))):
            own, asked = by[lo:hi][~is_query[by[lo:hi]]], by[lo:hi][is_query[by[lo:hi]]]
            if not len(own) or not len(asked):
                continue
            m, q = table.take(pa.array(own)), table.take(pa.array(asked))
            codes = np.frombuffer(b"".join(m.column("code").to_pylist()), np.uint8).reshape(len(own), -1)
            mine = (m.column("id").to_numpy(), codes, m.column("error").to_numpy(), _matrix(m.column("v").combine_chunks(), dim))
            theirs = (q.column("id").to_numpy(), q.column("own").to_numpy(), _matrix(q.column("v").combine_chunks(), dim))
            ids, place = np.unique(np.concatenate([mine[0], theirs[0]]), return_inverse=True)
            for a, b, c in _search(shared.value, mine, theirs, int(number[by[lo]]), radius, threshold):
                yield from emit(ids, place[len(own) :][a], place[: len(own)][b], c)

    return both.repartition("list", "part").mapInArrow(tidy(search), kinds)
