"""BPE encoding and decoding: speculate and verify.

Texts are cut into pieces (words with the space before them, numbers, marks,
white space) by the classes of their characters, for all texts of a block at
once.  Each distinct piece is encoded once: greedy longest match proposes its
tokens, and a vectorised look-up tests every adjacent pair of tokens for
compatibility.  A pair is compatible if byte-pair merging of its joined bytes
gives back that pair; a sequence whose neighbours are all compatible is what
merging gives, so only pieces with an incompatible pair are merged exactly.

The vocabulary is a file of base64 tokens and ranks, whose path is a
parameter; its bytes travel to the executors in a broadcast.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.common import bounded_batches, tidy
from docloom.llm.textvec import _BASE, code_points, mix, powers, text_parts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces that a worker remembers; beyond that it forgets them and the pairs it tested, and starts again.
_REMEMBERED = 400_000


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 anything else."""
    out = np.full(0x110000, 3, dtype=np.int8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            out[cp] = 1
        elif c == "N":
            out[cp] = 2
    out[_SPACES] = 0
    return out


def pieces(arr: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each piece of the texts whose code points lie one after another in arr.

    The cut is that of
    '(?:[sdmt]|ll|ve|re)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    if not len(arr):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = class_table()[arr]
    new = np.ones(len(arr), bool)
    np.not_equal(cls[1:], cls[:-1], out=new[1:])
    new[offset[:-1][offset[:-1] < len(arr)]] = True
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(arr))
    kind = cls[begin]
    text_start = np.zeros(len(arr) + 1, bool)
    text_start[offset] = True
    last = text_start[end]  # no run of the same text follows
    first = text_start[begin]
    space = kind == 0
    glued = np.zeros(len(begin), bool)  # the run before ends in a plain blank, which this run takes
    glued[1:] = space[:-1] & (arr[end[:-1] - 1] == 32) & ~first[1:] & ~space[1:]
    # contractions: a lone apostrophe without a blank, then letters
    cut = np.zeros(len(begin), np.int64)  # letters that the apostrophe before takes
    lone = np.flatnonzero((kind == 3) & (end - begin == 1) & (arr[begin] == 39) & ~glued & ~last)
    lone = lone[kind[lone + 1] == 1]
    if len(lone):
        at = begin[lone + 1]
        one = arr[at]
        two = np.where(end[lone + 1] - at > 1, arr[np.minimum(at + 1, len(arr) - 1)], 0)
        k = np.where(np.isin(one, [115, 100, 109, 116]), 1, np.where(((one == 108) & (two == 108)) | ((one == 118) & (two == 101)) | ((one == 114) & (two == 101)), 2, 0))
        cut[lone + 1] = k
    word = ~space
    wb, we = begin[word] - glued[word] + cut[word], end[word].copy()
    we += np.append(cut[1:], 0)[word]
    # white space: all but its last character, then the last unless a word took it
    sb, se, ends = begin[space], end[space], last[space]
    follows = np.append(glued[1:], False)[space]
    head_end = np.where(ends, se, se - 1)
    tail = ~ends & ~follows
    b = np.concatenate([wb, sb, se[tail] - 1])
    e = np.concatenate([we, head_end, se[tail]])
    real = e > b
    b, e = b[real], e[real]
    by = np.argsort(b, kind="stable")
    return b[by], e[by]


class Codec:
    """Encoder and decoder of one vocabulary, with what it has learnt about pieces and pairs."""

    def __init__(self, data: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        size = max(self.rank.values()) + 1
        self.token: list[bytes] = [b""] * size
        for t, r in self.rank.items():
            self.token[r] = t
        self.longest = max(map(len, self.rank))
        self.by_start: dict[bytes, int] = {}
        for t in self.rank:
            k = t[:2]
            self.by_start[k] = max(self.by_start.get(k, 0), len(t))
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.pair = np.zeros(0, np.int64)  # pairs tested so far, in order, and what the test said
        self.good = np.zeros(0, bool)
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.exact = 0

    def merge(self, piece: bytes) -> list[int]:
        """Byte-pair merging: again and again the adjacent pair of lowest rank, the leftmost of equals."""
        rank = self.rank
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 64:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [rank[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same with a heap, for pieces of any length."""
        import heapq

        rank, n = self.rank, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, size = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or len(parts[i]) + len(parts[j]) != size or rank.get(parts[i] + parts[j]) != r:
                continue
            parts[i] += parts[j]
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (x := rank.get(parts[a] + parts[after[a]])) is not None:
                    heapq.heappush(heap, (x, a, len(parts[a]) + len(parts[after[a]])))
        return [rank[p] for p, a in zip(parts, alive) if a]

    def propose(self, piece: bytes) -> list[int]:
        """Greedy longest match from the left."""
        rank, by_start, out, i, n = self.rank, self.by_start, [], 0, len(piece)
        while i < n:
            for k in range(min(by_start.get(piece[i : i + 2], 1), n - i), 0, -1):
                r = rank.get(piece[i : i + k])
                if r is not None:
                    out.append(r)
                    i += k
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of neighbours as it is."""
        code = left * len(self.token) + right
        at = np.minimum(np.searchsorted(self.pair, code), max(0, len(self.pair) - 1))
        new = np.unique(code if not len(self.pair) else code[self.pair[at] != code])
        if len(new):
            token, said = self.token, []
            for a, b in zip((new // len(token)).tolist(), (new % len(token)).tolist()):
                said.append(self.merge(token[a] + token[b]) == [a, b])
            by = np.argsort(pairs := np.concatenate([self.pair, new]), kind="stable")
            self.pair, self.good = pairs[by], np.concatenate([self.good, np.array(said, bool)])[by]
        return self.good[np.searchsorted(self.pair, code)]

    def learn(self, todo: list[bytes]) -> None:
        proposed = [self.propose(p) for p in todo]
        size = np.fromiter((len(p) for p in proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(size.sum()))
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(size) - 1] = False
        left = np.flatnonzero(inner)
        bad = np.zeros(len(flat), bool)
        bad[left] = ~self.compatible(flat[left], flat[left + 1])
        fails = np.add.reduceat(bad, np.cumsum(size) - size) > 0 if len(flat) else np.zeros(0, bool)
        for k, (p, ids) in enumerate(zip(todo, proposed)):
            self.known[p] = tuple(self.merge(p)) if fails[k] else tuple(ids)
        self.exact += int(fails.sum())

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts one after another, and their number in each text."""
        whole = "".join(texts)
        arr = code_points(whole)
        offset = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        begin, end = pieces(arr, offset)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        import pandas as pd

        total = np.zeros(len(arr) + 1, np.uint64)
        power, inverse = powers(_BASE, len(arr) + 1)
        np.cumsum((arr.astype(np.uint64) + np.uint64(1)) * power[: len(arr)], out=total[1:])
        number, kinds = pd.factorize(mix((total[end] - total[begin]) * inverse[begin]))
        first = np.zeros(len(kinds), np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        distinct = [whole[b:e].encode() for b, e in zip(begin[first].tolist(), end[first].tolist())]
        todo = [p for p in distinct if p not in self.known]
        if todo:
            if len(self.known) > _REMEMBERED:
                self.known.clear()
                self.pair, self.good = np.zeros(0, np.int64), np.zeros(0, bool)
                todo = distinct
            self.learn(list(dict.fromkeys(todo)))
        coded = [self.known[p] for p in distinct]
        size = np.fromiter((len(c) for c in coded), np.int64, len(coded))
        flat = np.fromiter((t for c in coded for t in c), np.int32, int(size.sum()))
        start = np.cumsum(size) - size
        count = size[number]
        done = np.cumsum(count)
        ids = flat[np.repeat(start[number] - (done - count), count) + np.arange(int(done[-1]))]
        upto = np.concatenate(([0], done))[np.searchsorted(begin, offset)]
        return ids, np.diff(upto)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens one after another."""
        if not len(ids):
            return b""
        n = self.length[ids]
        done = np.cumsum(n)
        return self.flat[np.repeat(self.start[ids] - (done - n), n) + np.arange(int(done[-1]))].tobytes()


_codecs: dict[int, Codec] = {}


def codec(shared) -> Codec:
    """The worker's codec for a broadcast vocabulary, made once."""
    data = shared.value
    key = hash(data)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data)
    return _codecs[key]


def _share(df: DataFrame, path: str):
    bounded_batches(df.sparkSession)
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of each row; round_trip: the tokens decode to the very bytes of the text.

    A null or empty text has no tokens; a text of any length is coded whole.
    Of pairs of equal rank the leftmost is merged first.  Rows are coded one by one, so
    repeated rows and null ids stay as they are; other columns are not looked
    at; an empty table gives an empty table.
    """
    shared = _share(docs, vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared)
        for batch in batches:
            for part, texts in text_parts(batch, 1):
                some = [t or "" for t in texts]
                ids, count = c.encode_block(some)
                data = c.decode_bytes(ids)
                at = np.concatenate(([0], np.cumsum(count)))
                ends = np.concatenate(([0], np.cumsum(c.length[ids])))[at].tolist()
                same = [data[a:b] == t.encode() for a, b, t in zip(ends, ends[1:], some)]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, len(some)).cast(pa.int64()), pa.array(count), lists, pa.array(same)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text, and bytes that are not UTF-8 the replacement character."""
    shared = _share(encoded, vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared)
        for batch in batches:
            texts = [c.decode_bytes(np.asarray(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")
