"""Quality classifier: an interpolated modified Kneser-Ney n-gram model.

The model is over characters, N at a time, one per language, and is trained on
the trusted documents.  Words would not do here: every occurrence would have
to cross the network to meet its count, whereas the distinct runs of a few
characters are aggregated on the side of the scan.

Counts, continuation counts, discounts and back-off weights come from joins
and aggregations that are sharded by (lang, gram).  The finished table of
log-probabilities travels to the scan of the documents while it is under the
broadcast limit; beyond it, it is a file in the shared folder, filled shard by
shard, which the scan maps into memory.  Only where that folder is none of the
file system are each document's distinct grams joined with the shards of each
order, which moves many times the documents' size.  A tenth of the trusted documents, chosen by a hash of
the id, trains nothing and sets the threshold: that quantile of its
perplexities in the language, for documents of about the same length.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_BYTES, bounded_batches, checked_broadcast, discard, keep_ids, local_folder, materialise, small_enough, tidy
from docloom.llm.textvec import code_points, text_parts

N = 5
#: Share of held-out trusted documents, of one language and length, that stays under the threshold.
QUANTILE = 0.995
#: A threshold is this much above the quantile.
MARGIN = 1.02
HELD_OUT = 10
BOS, EOS = "\x02", "\x03"
#: Lengths are told apart by the power of 4, from 4**_LOW to 4**_HIGH characters.
_LOW, _HIGH = 2, 7
_ROW_BYTES = 32
#: The same for a side of a join while the model is built.
_SIDE_BYTES, _SIDE_LIMIT = 100, 16 << 20
_HELD = 6_000_000
#: Rows of the model in a shard of a table that is filled shard by shard.
_SHARD_ROWS = 1 << 18
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_LANG = np.uint64(0x589965CC75374CC3)
_ORDER = np.uint64(0x1D8E4E27C47D124F)


def band(chars: int | np.ndarray) -> np.ndarray:
    """Number of the length class."""
    return np.clip(np.floor(np.log2(np.maximum(1, chars)) / 2), _LOW, _HIGH).astype(np.int64)


def _laid_out(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after n - 1 marks of its begin and before one of its end, and where each text's marks begin."""
    arr = code_points("".join(BOS * (n - 1) + t + EOS for t in texts))
    start = np.concatenate(([0], np.cumsum([len(t) + n for t in texts], dtype=np.int64)))
    return arr, start


def _hashes(arr: np.ndarray, lang: np.ndarray, n: int) -> np.ndarray:
    """Of the n symbols that end at each place from n - 1 on; lang: a number for the language at each place."""
    m = len(arr) - n + 1
    h = lang[n - 1 :] * _LANG + np.uint64(n) * _ORDER
    for k in range(n):
        h = h + (arr[n - 1 - k : n - 1 - k + m].astype(np.uint64) + np.uint64(1)) * _K[k]
    return h


def lang_number(lang: str | None) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("" if lang is None else "=" + lang)


def gram_counts(docs: DataFrame, n: int) -> DataFrame:
    """(lang, gram, c): runs of n symbols and their counts; summed on the scan's side first."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("c", pa.int64())])

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        if not held:
            return
        number, kinds = pd.factorize(np.concatenate([h for h, _, _, _ in held]))
        total = np.bincount(number, np.concatenate([c for _, c, _, _ in held]), len(kinds)).astype(np.int64)
        first = np.zeros(len(kinds), np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        grams = np.concatenate([g for _, _, g, _ in held])[first]
        langs = np.concatenate([x for _, _, _, x in held])[first]
        whole = grams.astype("<u4").tobytes().decode("utf-32-le")
        names = [whole[i : i + n] for i in range(0, len(whole), n)]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(total)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        held, size = [], 0
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for part, some in text_parts(batch, 1):
                own = langs[part]
                arr, start = _laid_out(some, n)
                lang = np.repeat(np.array([lang_number(x) for x in own], np.uint64), np.diff(start))
                h = _hashes(arr, lang, n)
                at = np.arange(n - 1, len(arr))
                inside = at - np.repeat(start[:-1], np.diff(start))[n - 1 :] >= n - 1
                h, at = h[inside], at[inside]
                number, kinds = pd.factorize(h)
                first = np.zeros(len(kinds), np.int64)
                first[number[::-1]] = np.arange(len(number))[::-1]
                places = at[first]
                texts_of = np.searchsorted(start, places, side="right") - 1
                held.append((kinds, np.bincount(number, minlength=len(kinds)), arr[places[:, None] + np.arange(1 - n, 1)], np.array(own, object)[texts_of]))
                size += len(kinds)
                if size > _HELD:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)

    return docs.select("lang", "text").mapInArrow(tidy(run), "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) from the numbers of grams that were counted once to four times."""
    times = [F.sum((F.col("c") == k).cast("long")).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    some = counts.groupBy("lang").agg(*times)
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
    one = some.withColumn("y", y)

    def d(k: int) -> Column:
        raw = F.lit(float(k)) - F.lit(float(k + 1)) * F.col("y") * F.col(f"n{k + 1}") / F.col(f"n{k}")
        return F.least(F.greatest(F.when(F.col(f"n{k}") > 0, raw).otherwise(F.lit(0.5 * k)), F.lit(0.05)), F.lit(k - 0.05)).alias(f"d{k}")

    return one.select("lang", d(1), d(2), d(3))


def _same(a: DataFrame, b: DataFrame, *pairs: tuple[str, str], how: str = "inner") -> DataFrame:
    """Join that takes two nulls as equal; b is sent to a if a count shows it to be small."""
    b = checked_broadcast(b, _SIDE_BYTES, _SIDE_LIMIT)
    on = None
    for x, y in pairs:
        c = a[x].eqNullSafe(b[y])
        on = c if on is None else on & c
    return a.join(b, on, how).drop(*(b[y] for _, y in pairs))


def train(docs: DataFrame, n: int = N) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, gram, logp, backoff) of every gram of 1 to n symbols and every context, in the manner of an ARPA file; and the written tables that it is read from.

    One row has the logp of a gram, another the backoff of the same as a
    context.  The empty gram's logp is that of a symbol never seen.
    """
    counts = materialise(gram_counts(docs, n), "grams")
    tables = [counts]
    for k in range(n - 1, 0, -1):  # continuation counts: kinds of symbols before
        tables.append(materialise(tables[-1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")), f"continued{k}"))
    lower, out, used = None, None, [*tables]
    for k, table in enumerate(reversed(tables), 1):
        discount = materialise(_discounts(table), f"discounts{k}")
        c, few = F.col("c"), lambda *x: F.sum((F.col("c") == x[0] if len(x) == 1 else F.col("c") >= x[0]).cast("long"))
        contexts = table.groupBy("lang", F.substring("gram", 1, k - 1).alias("ctx")).agg(F.sum("c").alias("total"), few(1).alias("m1"), few(2).alias("m2"), few(3, 4).alias("m3"))
        contexts = _same(contexts, discount.withColumnRenamed("lang", "l2"), ("lang", "l2"))
        contexts = materialise(contexts, f"contexts{k}")
        used += [discount, contexts]
        contexts = contexts.withColumn("gamma", (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total"))
        own = contexts.select(F.col("lang").alias("l3"), "ctx", "total", "gamma", "d1", "d2", "d3", (F.col("m1") + F.col("m2") + F.col("m3")).alias("kinds"))
        p = _same(table.withColumn("c1", F.substring("gram", 1, k - 1)), own, ("lang", "l3"), ("c1", "ctx"))
        d = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        if lower is None:
            below = F.lit(1.0) / (F.col("kinds") + 1)
            unknown = contexts.select("lang", F.lit("").alias("gram"), F.log(F.col("gamma") / (F.col("m1") + F.col("m2") + F.col("m3") + 1)).alias("logp"), F.lit(None).cast("double").alias("backoff"))
        else:
            side = lower.select(F.col("lang").alias("l4"), F.col("gram").alias("tail"), F.col("p").alias("below"))
            p = _same(p.withColumn("t1", F.substring("gram", 2, k - 1)), side, ("lang", "l4"), ("t1", "tail"))
            below = F.col("below")
        p = materialise(p.select("lang", "gram", ((c - d) / F.col("total") + F.col("gamma") * below).alias("p")), f"p{k}")
        used.append(p)
        rows = p.select("lang", "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("backoff"))
        if k > 1:
            rows = rows.union(contexts.select("lang", "ctx", F.lit(None).cast("double"), F.log("gamma")))
        else:
            rows = rows.union(unknown)
        out, lower = rows if out is None else out.union(rows), p
    return out, used


def _gram_hashes(model: DataFrame, n: int) -> DataFrame:
    """(key, logp, backoff) of the model's rows, and the number of the language as key in those of the empty gram, which have `empty` set."""
    schema = pa.schema([("key", pa.int64()), ("logp", pa.float32()), ("backoff", pa.float32()), ("empty", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, gram = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            numbers = {x: lang_number(x) for x in set(lang)}
            of = np.array([numbers[x] for x in lang], np.uint64)
            size = np.fromiter((len(g) for g in gram), np.int64, len(gram))
            key = of.copy()
            for k in range(1, n + 1):
                at = np.flatnonzero(size == k)
                if len(at):
                    arr = code_points("".join(gram[i] for i in at.tolist())).reshape(-1, k).astype(np.uint64)
                    h = of[at] * _LANG + np.uint64(k) * _ORDER
                    for j in range(k):
                        h = h + (arr[:, k - 1 - j] + np.uint64(1)) * _K[j]
                    key[at] = h
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(2).cast(pa.float32()), batch.column(3).cast(pa.float32()), pa.array(size == 0)], schema=schema)

    return model.select("lang", "gram", "logp", "backoff").mapInArrow(tidy(run), "key long, logp float, backoff float, empty boolean")


class Table:
    """The model as an open-addressing hash table."""

    def __init__(self, rows: pa.Table, n: int):
        self.n = n
        real = ~rows.column("empty").to_numpy()
        none = rows.filter(pa.array(~real))
        self.unknown = {int(k) & 0xFFFFFFFFFFFFFFFF: p for k, p in zip(none.column("key").to_pylist(), none.column("logp").to_pylist())}
        rows = rows.filter(pa.array(real))
        key = rows.column("key").to_numpy().view(np.uint64)
        by = np.argsort(key)
        key = key[by]
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        row = (np.cumsum(new) - 1).astype(np.int32)  # logp and backoff come in rows of their own
        key = key[new]
        bits = max(10, int(np.ceil(np.log2(2 * len(key) + 1))))
        self.shift = np.uint64(64 - bits)
        # keys in order go to the first free slot from their own on: that of the key before, or further
        slot = (key >> self.shift).astype(np.int64) - np.arange(len(key))
        slot = np.maximum.accumulate(slot) + np.arange(len(key)) if len(key) else slot
        size = max(1 << bits, int(slot[-1]) + 1 if len(key) else 0) + 1  # the last one stays free
        self.key, self.full = np.zeros(size, np.uint64), np.zeros(size, bool)
        self.key[slot], self.full[slot] = key, True
        del key, new
        for name in ("logp", "backoff"):
            values = rows.column(name).to_numpy()[by]
            there = np.flatnonzero(~np.isnan(values))
            column = np.full(size, np.nan, np.float32)
            column[slot[row[there]]] = values[there]
            setattr(self, name, column)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 for those not there."""
        slot = (h >> self.shift).astype(np.int64)
        hit = (self.key[slot] == h) & self.full[slot]
        out = np.where(hit, slot, -1)
        todo = np.flatnonzero(~hit & self.full[slot])
        while len(todo):
            s = slot[todo] + 1
            slot[todo] = s
            hit = (self.key[s] == h[todo]) & self.full[s]
            out[todo[hit]] = s[hit]
            todo = todo[~hit & self.full[s]]
        return out

    def scores(self, texts: list[str], langs: list[str | None]) -> np.ndarray:
        """Sum of the log-probabilities of each text's symbols and its end; nan where the language has no model."""
        n = self.n
        arr, start = _laid_out(texts, n)
        numbers = [lang_number(x) for x in langs]
        lang = np.repeat(np.array(numbers, np.uint64), np.diff(start))
        total = np.zeros(len(arr))
        h = _hashes(arr, lang, n)
        slot = self.find(h)
        p = np.where(slot >= 0, self.logp[slot], np.nan)
        total[n - 1 :] = p
        inside = np.arange(len(arr)) - np.repeat(start[:-1], np.diff(start)) >= n - 1
        todo = np.flatnonzero(inside & np.isnan(total))
        weight = np.zeros(len(todo))
        for k in range(n - 1, -1, -1):  # down to the empty gram
            if not len(todo):
                break
            slot = self.find(self._at(arr, lang, todo - 1, k)) if k else np.full(len(todo), -1)
            bow = np.where(slot >= 0, self.backoff[slot], 0.0)
            weight += np.where(np.isnan(bow), 0.0, bow)
            if k:
                slot = self.find(self._at(arr, lang, todo, k))
                p = np.where(slot >= 0, self.logp[slot], np.nan)
            else:
                p = np.array([self.unknown.get(int(x), np.nan) for x in lang[todo].tolist()])
            done = ~np.isnan(p) if k else np.ones(len(todo), bool)
            total[todo[done]] = weight[done] + p[done]
            todo, weight = todo[~done], weight[~done]
        total[~inside] = 0
        return np.add.reduceat(total, start[:-1])

    @staticmethod
    def _at(arr: np.ndarray, lang: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k symbols that end at each place."""
        h = lang[place] * _LANG + np.uint64(k) * _ORDER
        for j in range(k):
            h = h + (arr[place - j].astype(np.uint64) + np.uint64(1)) * _K[j]
        return h


class MappedTable(Table):
    """The same table in files: whoever scores with it maps them, and no process holds it whole."""

    COLUMNS = {"key": np.uint64, "full": bool, "logp": np.float32, "backoff": np.float32}

    def __init__(self, shards: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], keys: int, unknown: dict[int, float], n: int, folder: str):
        """shards: keys, each once, logp and backoff (nan: none), in order of the keys; keys: how many in all."""
        self.n, self.unknown, self.folder = n, unknown, folder
        bits = max(10, int(np.ceil(np.log2(2 * keys + 1))))
        self.shift = np.uint64(64 - bits)
        os.makedirs(folder)
        files = {name: open(f"{folder}/{name}", "wb") for name in self.COLUMNS}
        at = 0  # the first slot that is not written

        def write(size: int, slot: np.ndarray, **values: np.ndarray) -> None:
            for name, kind in self.COLUMNS.items():
                column = np.full(size, np.nan, kind) if kind is np.float32 else np.zeros(size, kind)
                if len(slot):
                    column[slot] = values[name]
                files[name].write(column.tobytes())

        for key, logp, backoff in shards:
            if not len(key):
                continue
            step = np.arange(len(key))
            slot = (key >> self.shift).astype(np.int64) - step
            slot[0] = max(slot[0], at)
            slot = np.maximum.accumulate(slot) + step
            write(int(slot[-1]) + 1 - at, slot - at, key=key, full=np.ones(len(key), bool), logp=logp, backoff=backoff)
            at = int(slot[-1]) + 1
        while at <= 1 << bits:  # the last one stays free
            size = min((1 << bits) + 1 - at, 1 << 20)
            write(size, np.zeros(0, np.int64))
            at += size
        write(1, np.zeros(0, np.int64))
        for f in files.values():
            f.close()

    def __getattr__(self, name: str) -> np.ndarray:
        if name not in MappedTable.COLUMNS:
            raise AttributeError(name)
        column = np.memmap(f"{self.folder}/{name}", dtype=self.COLUMNS[name], mode="r").view(np.ndarray)
        self.__dict__[name] = column
        return column

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in self.COLUMNS}


def _score_blocks(shared, langs: list, batch: pa.RecordBatch, column: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Of each block: where it is, perplexities (nan: none) and lengths."""
    for part, texts in text_parts(batch, column):
        some = [t or "" for t in texts]
        size = np.fromiter((len(t) for t in some), np.int64, len(some))
        yield part, np.where(size > 0, np.exp(-shared.value.scores(some, langs[part]) / (size + 1)), np.nan), size


def _broadcast(model: DataFrame, n: int):
    return model.sparkSession.sparkContext.broadcast(Table(_gram_hashes(model, n).toArrow(), n))


def _mapped(model: DataFrame, n: int, folder: str):
    """The table of a model of any size, in files of a folder that all executors share; the driver holds a shard at a time."""
    spark = model.sparkSession
    bits = max(0, int(np.ceil(np.log2(max(1, model.count()) / _SHARD_ROWS))))
    schema = pa.schema([("shard", pa.int64()), ("keys", pa.int64()), ("key", pa.binary()), ("logp", pa.binary()), ("backoff", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        key = rows.column("key").to_numpy().view(np.uint64)
        by = np.argsort(key)
        key = key[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        row = np.cumsum(new) - 1  # logp and backoff come in rows of their own
        key, columns = key[new], []
        for name in ("logp", "backoff"):
            values = rows.column(name).to_numpy()[by]
            there = np.flatnonzero(~np.isnan(values))
            columns.append(np.full(len(key), np.nan, np.float32))
            columns[-1][row[there]] = values[there]
        shard = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
        first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        parts = [np.split(x, first[1:]) for x in (key, *columns)]
        yield pa.RecordBatch.from_arrays([pa.array(shard[first]), pa.array([len(x) for x in parts[0]], pa.int64()), *(pa.array([x.tobytes() for x in some], pa.binary()) for some in parts)], schema=schema)

    hashed = materialise(_gram_hashes(model, n), "hashed")
    unknown = {r["key"] & 0xFFFFFFFFFFFFFFFF: r["logp"] for r in hashed.filter("empty").select("key", "logp").collect()}
    of = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    shards = hashed.filter("NOT empty").withColumn("shard", of).repartition("shard").drop("shard")
    shards = materialise(shards.mapInArrow(tidy(run), "shard long, keys long, key binary, logp binary, backoff binary"), "shards")
    keys = shards.agg(F.coalesce(F.sum("keys"), F.lit(0))).first()[0]
    whole = (tuple(np.frombuffer(bytes(r[c]), kind) for c, kind in (("key", np.uint64), ("logp", np.float32), ("backoff", np.float32))) for k in range(1 << bits) for r in shards.filter(F.col("shard") == k).collect())
    table = MappedTable(whole, keys, unknown, n, f"{folder}/table-{uuid.uuid4().hex}")
    discard(hashed, shards)
    return spark.sparkContext.broadcast(table)


def _scan(docs: DataFrame, shared) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("perplexity", pa.float64()), ("band", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for part, value, size in _score_blocks(shared, langs, batch, 2):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, len(size)).cast(pa.int64()), pa.array(langs[part], pa.string()), pa.array(value, from_pandas=True), pa.array(band(size))], schema=schema)

    return docs.select("doc_id", "lang", "text").mapInArrow(tidy(run), "doc_id long, lang string, perplexity double, band long")


def _joined(docs: DataFrame, model: DataFrame, n: int) -> DataFrame:
    """The same as _scan by joins of each document's grams with the model's shards, for a model of any size."""
    keyed = materialise(docs.select(F.expr("uuid()").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), "scored")
    return _joined_rows(keyed, model, n).drop("row")


def _joined_rows(keyed: DataFrame, model: DataFrame, n: int) -> DataFrame:
    """(row, doc_id, lang, perplexity, band) of rows that are named by a written key `row`."""
    schema = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("lang", pa.string()), ("band", pa.int64()), ("chars", pa.int64()), ("gram", pa.string()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            rows = []
            for row, ident, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not text:
                    rows.append((row, ident, lang, _LOW, 0, None, 0))
                    continue
                laid = BOS * (n - 1) + text + EOS
                b = int(band(len(text)))
                rows += [(row, ident, lang, b, len(text), g, k) for g, k in Counter(laid[i : i + n] for i in range(len(text) + 1)).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, schema.types)], schema=schema)

    out = keyed.mapInArrow(tidy(run), "row string, doc_id long, lang string, band long, chars long, gram string, times long")
    out = out.withColumn("weight", F.lit(0.0)).withColumn("found", F.lit(None).cast("double"))
    for k in range(n, -1, -1):
        side = model.filter("logp IS NOT NULL").select(F.col("lang").alias("l2"), F.col("gram").alias("g2"), F.col("logp").alias("lp"))
        if k < n:
            bows = model.filter("backoff IS NOT NULL").select(F.col("lang").alias("l3"), F.col("gram").alias("g3"), "backoff")
            out = _same(out.withColumn("ctx", F.expr(f"substring(gram, {n - k}, {k})")), bows, ("lang", "l3"), ("ctx", "g3"), how="left").drop("ctx")
            out = out.withColumn("weight", F.when(F.col("found").isNull() & F.lit(k > 0), F.col("weight") + F.coalesce("backoff", F.lit(0.0))).otherwise(F.col("weight"))).drop("backoff")
        out = _same(out.withColumn("own", F.expr(f"substring(gram, {n - k + 1}, {k})")), side, ("lang", "l2"), ("own", "g2"), how="left").drop("own")
        out = out.withColumn("found", F.coalesce("found", F.col("weight") + F.col("lp"))).drop("lp")
    total = out.groupBy("row", "doc_id", "lang", "band", "chars").agg(F.sum(F.col("found") * F.col("times")).alias("s"))
    return total.select("row", "doc_id", "lang", F.when(F.col("chars") > 0, F.exp(-F.col("s") / (F.col("chars") + 1))).alias("perplexity"), "band")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("held-out")), F.lit(HELD_OUT)) == 0


class Classifier:
    """A trained model with its thresholds."""

    def __init__(self, trusted: DataFrame, n: int = N, quantile: float = QUANTILE, limit: int = BROADCAST_BYTES):
        bounded_batches(trusted.sparkSession)
        trusted = trusted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").filter(F.length("text") > 0)
        self.n = n
        model, used = train(trusted.filter(~held_out(F.col("doc_id"))), n)
        self.model = materialise(model, "model")
        discard(*used)
        folder = local_folder(trusted.sparkSession)
        if small_enough(self.model, _ROW_BYTES, limit):
            self.shared = _broadcast(self.model, n)
        else:
            self.shared = _mapped(self.model, n, folder) if folder else None
        scored = self.score(trusted.filter(held_out(F.col("doc_id")))).filter("perplexity IS NOT NULL AND NOT isnan(perplexity)")
        at = F.percentile_approx("perplexity", quantile, 10_000)
        scored = materialise(scored, "held-out")
        rows = scored.groupBy("lang", "band").agg(at.alias("p"), F.count("*").alias("n")).collect()
        whole = {r["lang"]: r["p"] for r in scored.groupBy("lang").agg(at.alias("p")).collect()}
        # too few of a length to tell a quantile: no lower than that of any length
        self.limits = {(r["lang"], b): MARGIN * whole[r["lang"]] for r in rows for b in range(_LOW, _HIGH + 1)}
        for r in rows:
            own = r["p"] if r["n"] * (1 - quantile) >= 1 else max(r["p"], whole[r["lang"]])
            self.limits[r["lang"], r["band"]] = MARGIN * own
        self._widen()

    def _widen(self) -> None:
        """Shorter texts vary more: no class has a limit under that of a longer one."""
        for lang in {x for x, _ in self.limits}:
            for b in range(_HIGH - 1, _LOW - 1, -1):
                self.limits[lang, b] = max(self.limits[lang, b], self.limits[lang, b + 1])

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, lang, perplexity, band)."""
        return _scan(docs, self.shared) if self.shared is not None else _joined(docs, self.model, self.n)

    def accepted(self, docs: DataFrame) -> DataFrame:
        """(doc_id, lang, perplexity, threshold) of the documents that are not rejected."""
        return self._accepted(self.score(docs)).select("doc_id", "lang", "perplexity", "threshold")

    def _accepted(self, scored: DataFrame) -> DataFrame:
        spark = scored.sparkSession
        limits = spark.createDataFrame([(a, b, c) for (a, b), c in self.limits.items()], "l string, b long, threshold double")
        out = scored.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("l")) & (F.col("band") == F.col("b")), "left")
        out = out.withColumn("perplexity", F.when(~F.isnan("perplexity"), F.col("perplexity")))
        return out.filter(~F.coalesce(F.col("perplexity") > F.col("threshold"), F.lit(False)))

    def keep(self, docs: DataFrame) -> DataFrame:
        """docs without the rejected, with all columns; each row is judged by itself, whatever its id."""
        if self.shared is None:
            key = f"row_{uuid.uuid4().hex}"
            keyed = materialise(docs.withColumn(key, F.expr("uuid()")), "keyed")
            rows = keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
            good = materialise(self._accepted(_joined_rows(rows, self.model, self.n)).select("row"), "accepted")
            good = checked_broadcast(good, 64)
            return keyed.join(good, keyed[key] == good["row"], "left_semi").select(docs.columns)
        at_lang, at_text = docs.columns.index("lang"), docs.columns.index("text")
        shared, limits = self.shared, self.limits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs = batch.column(at_lang).to_pylist()
                good = np.ones(len(langs), bool)
                for part, value, size in _score_blocks(shared, langs, batch, at_text):
                    most = np.array([limits.get((x, int(b)), np.inf) for x, b in zip(langs[part], band(size))])
                    good[part] = ~(value > most)
                yield batch.filter(pa.array(good))

        return docs.mapInArrow(tidy(run), docs.schema)


def fit(docs: DataFrame, labels: DataFrame, **kwargs) -> Classifier:
    """A classifier trained on the documents that are labelled as of quality 1 and never as of 0.

    A text that is null or empty has no perplexity and is never rejected, nor
    is one whose language has no trusted documents; a null language is one of
    its own.  A text of any length is scored whole, and one whose perplexity
    equals its threshold stays.  A null id is in no label.  Rows that repeat count each time.  An
    empty table of documents or labels rejects nothing.  Columns other than
    doc_id, lang, text and quality are not looked at.
    """
    ids = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    return Classifier(keep_ids(docs.select("doc_id", "lang", "text"), ids, "left_semi"), **kwargs)
