"""Vectorised text kernels shared by the corpus operators.

Texts are laid out as one array of code points per block, and words, word
hashes and rolling n-gram hashes are all computed with numpy over the whole
block, so no Python code runs per word.  A word is a maximal run of letters,
marks and digits of the lower-cased text; hashes are Karp-Rabin polynomials
modulo 2**64 and depend on the word alone, never on its place.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_CHARS = 500_000
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """True for each code point that may be part of a word."""
    out = np.zeros(0x110000, dtype=bool)
    for cp in range(0x110000):
        out[cp] = unicodedata.category(chr(cp))[0] in "LMN"
    return out


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for 0 <= i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.ones(size, dtype=np.uint64)
            filled = 1
            while filled < size:
                step = np.uint64(pow(b, filled, 1 << 64))
                more = min(filled, size - filled)
                out[filled : filled + more] = out[:more] * step
                filled += more
            both.append(out)
        have = _powers[base] = (both[0], both[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Words:
    """The words of several texts: hash, text number and start of each text's words."""

    __slots__ = ("hash", "doc", "first", "begin", "end", "n")

    def __init__(self, texts: list[str]):
        lowered = [(t or "").lower() for t in texts]
        self.n = len(lowered)
        arr = code_points("\n".join(lowered))
        lengths = np.fromiter((len(t) + 1 for t in lowered), dtype=np.int64, count=self.n)
        offset = np.zeros(self.n + 1, dtype=np.int64)
        np.cumsum(lengths, out=offset[1:])
        flag = np.zeros(len(arr) + 2, dtype=np.int8)
        flag[1:-1] = word_table()[arr]
        edge = np.flatnonzero(flag[1:] != flag[:-1])
        begin, end = edge[0::2], edge[1::2]
        total = np.zeros(len(arr) + 1, dtype=np.uint64)
        power, inverse = powers(_BASE, len(arr) + 1)
        np.cumsum((arr.astype(np.uint64) + np.uint64(1)) * power[: len(arr)], out=total[1:])
        self.hash = mix((total[end] - total[begin]) * inverse[begin])
        self.doc = np.searchsorted(offset, begin, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))
        self.begin, self.end = begin - offset[self.doc], end - offset[self.doc]

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.first[i] : self.first[i + 1]]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words within one text, and the place of its first word."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        place = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        return gram_hashes(self.hash, k)[place], place


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of every run of k values of h."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(_GRAM, len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[:m])


def blocks(lengths: np.ndarray, limit: int = BLOCK_CHARS) -> Iterator[slice]:
    """Consecutive slices whose lengths add up to about limit; a longer text is one slice."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def text_blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[slice]:
    return blocks(np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts)), limit)


def text_parts(batch: pa.RecordBatch, column: int, limit: int = BLOCK_CHARS) -> Iterator[tuple[slice, list[str | None]]]:
    """The batch's texts in blocks of about limit bytes, of which one at a time is made into Python strings."""
    texts = batch.column(column)
    for part in blocks(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), limit):
        yield part, texts.slice(part.start, part.stop - part.start).to_pylist()


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by doubling."""
    if len(a) < w:
        return a[:0]
    out, span = a, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def sliding_max(a: np.ndarray, w: int) -> np.ndarray:
    return ~sliding_min(~a, w)
