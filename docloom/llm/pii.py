"""PII: weak supervision of span labelers.

One scan finds candidate spans: whatever has the rough form of an address, a
number, a key or a secret.  Labelers of three sorts vote on each: regular
expressions and check digits, gazetteers (top-level domains, country codes,
card issuers, key prefixes) and the context to the left and right.  Equal
votes are counted over the whole corpus, so what reaches the driver is a table
of patterns whose size depends on the labelers and not on the data.

Expectation-maximisation estimates, without labels, how often each labeler
votes which way on true and on false candidates, and the share of true ones of
each kind.  Its posteriors then train a logistic span classifier on features of
the span itself, and that classifier decides every candidate.  Each form
proposes its candidates whatever the others propose; overlaps are resolved
among those that were accepted.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, materialise, tidy
from docloom.llm.textvec import code_points, text_blocks, text_parts

THRESHOLD = 0.5
KINDS = ("email", "phone", "card", "ip", "key", "secret", "number", "iban", "national", "address", "name")
#: Characters around a mark that are looked at beyond the word it stands in.
_AROUND = 48
_MARKS = np.zeros(0x110000, bool)
_MARKS[[*range(48, 58), ord("@"), ord("="), ord(":")]] = True
_SPACE = np.zeros(0x110000, bool)
_SPACE[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029]] = True

_FORMS = (
    ("secret", re.compile(r"(?i)\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth)\b[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?([^\s\"',;]{4,})"), 1),
    # only from where a word begins: from each of its letters, a long one would be searched for an @ again and again
    ("email", re.compile(r"(?<![^\s@<>()\[\]\"',;:|])[^\s@<>()\[\]\"',;:|]+@[^\s@<>()\[\]\"',;:|]*[^\s@<>()\[\]\"',;:|.!?]"), 0),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)|(?<![\w:.])(?=[0-9A-Fa-f:]{0,36}[0-9A-Fa-f]{3})(?:[0-9A-Fa-f]{1,4}:){1,7}(?::[0-9A-Fa-f]{1,4}){0,6}(?:[0-9A-Fa-f]{1,4}|:)(?![\w:.])"), 0),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?!\w)"), 0),
    ("national", re.compile(r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?\d{2} ?\d{3} ?\d{3} ?\d{2})(?![\w-])"), 0),
    ("address", re.compile(r"(?<![\w.,-])\d{1,5}[A-Za-z]?,? (?:(?:rue|avenue|av\.|boulevard|bd|place|chemin|calle|avenida|plaza|paseo)(?: (?:de|du|des|la|las|los|del|l['’])){0,2}[ ]?[^\W\d_][\w'’-]{1,30}(?: [A-ZÀ-Ý][\w'’-]{1,30}){0,2}|[A-Z][\w'-]{1,30}(?: [A-Z][\w'-]{1,30}){0,2} (?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Way)\b\.?)|(?<!\w)(?:[A-ZÄÖÜ][\wäöüß-]{1,30}(?:stra(?:ße|sse)|str\.|weg|platz|allee|gasse)|(?:Calle|Avenida|Plaza|Paseo)(?: (?:de|la|las|los|del)){0,2} [A-ZÀ-Ý]\w{1,30},?) \d{1,4}[a-z]?(?!\w)"), 0),
    ("name", re.compile(r"(?<!\w)(?:(?:full|first|last|user|sur)?[ _-]?name|nombre|nom|Name)[ \t]{0,3}[:=][ \t]{0,3}([A-ZÀ-Ý][\w'’-]{1,30}(?: [A-ZÀ-Ý][\w'’-]{1,30}){1,3})"), 1),
    # international, in groups of any length; groups of two; an area code and a long group; groups of three and four
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]\d{2,8}){1,5}(?!\w|[.-]\d)|(?<![\w+.-])\d{2}(?:[ .-]\d{2}){3,4}(?![\w]|[.-]\d)|(?<![\w+.-])\(?\d{2,5}\)?[ /-]\d{5,8}(?!\w)|(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)"), 0),
    ("card", re.compile(r"(?<![\w.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)"), 0),
    ("key", re.compile(r"(?<![\w/+-])(?=[\w-]*\d)(?=[\w-]*[^\W\d_])[\w-]{16,}(?![\w/+-])"), 0),
    ("number", re.compile(r"(?<![\w.])\d[\d.,:/-]*(?!\w)"), 0),
)
_STRICT = {
    "secret": re.compile(r"[\x21-\x7e]{6,}$"),
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.|$)){4}$|(?=[^.]*$)(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$|(?=[^.]*::)(?!.*::.*::)[0-9A-Fa-f:]{3,39}$"),
    "iban": re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$"),
    "national": re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]$|[\dXYZ]-?\d{7}-?[A-Z]$|[12][\d ]+$"),
    "address": re.compile(r".{6,}$"),
    "name": re.compile(r"[^\W\d_][^\d_]*$"),
    "phone": re.compile(r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}$|\(\d{3}\) ?\d{3}-\d{4}$|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]\d{2,8}){1,5}$|0\d(?:[ .-]\d{2}){4}$|\(?0\d{1,4}\)?[ /-]\d{5,8}$"),
    "card": re.compile(r"\d{13,19}$|\d{4}(?:[ -]\d{4}){3}$"),
    "key": re.compile(r"(?:[A-Z]{2,6}[A-Z0-9]{12,}|[a-z]{2,4}[_-][A-Za-z0-9_-]{16,}|[0-9a-f]{24,})$"),
}
#: Four numbers between dots are an address, not a phone number in groups.
_DOTTED = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}$")
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io co dev app de fr es it uk eu us ca ch at be nl pl pt se no fi dk ru cn jp in br mx au example test local".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 354 358 420 421".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "36", "38", "62")
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "xox", "sk-", "sk_", "pk_", "glpat-")
IBAN_COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
#: Words after "name:" that are no part of a person's.
TITLES = frozenset("The A An This Of And File Table Class Package Host Domain Server Your".split())
NOT_SECRETS = frozenset("your changeme example none null true false required optional string hidden".split())
_CUES = {
    "email": re.compile(r"(?i)e-?mail|mailto|contact|write|from|address"),
    "phone": re.compile(r"(?i)phone|tel|call|fax|mobile|cell|whatsapp"),
    "card": re.compile(r"(?i)card|visa|credit|debit|payment|iban|account"),
    "ip": re.compile(r"(?i)\bip\b|host|server|addr|client|login|from"),
    "key": re.compile(r"(?i)key|token|secret|aws|access|auth|credential"),
    "secret": re.compile(r"(?i)pass|pwd|secret|token|key|auth"),
    "number": re.compile(r"(?!)"),
    "iban": re.compile(r"(?i)iban|account|bank|konto|compte|cuenta|transfer"),
    "national": re.compile(r"(?i)ssn|social|security|insurance|national|\bid\b|dni|nie|nino|insee|tax"),
    "address": re.compile(r"(?i)address|adresse|direcci|live|street|ship|deliver|home|wohn"),
    "name": re.compile(r"(?i)name|nom"),
}
_AGAINST = re.compile(r"(?i)(?:version|licen[sc]e|by(?:-\w+)*|v\.?|release|section|chapter|page|vol\.?|no\.?|figure|table|isbn|rfc|since|year|isn't|§|#|[$€£])\W{0,3}$")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[0::2]) % 10 == (-sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10


def _regex(kind: str, span: str) -> int:
    return 0 if kind not in _STRICT else 1 if _STRICT[kind].match(span) else -1


def _checks(kind: str, span: str) -> int:
    digits = re.sub(r"\D", "", span)
    if kind == "card":
        return 1 if luhn(digits) else -1
    if kind == "ip":
        return (1 if valid_v6(span) else -1) if ":" in span else 1 if all(int(x) < 256 for x in span.split(".")) else -1
    if kind == "iban":
        return 1 if mod_97(span) else -1
    if kind == "national":
        return national(span)
    if kind in ("address", "name"):
        return 1 if sum(w[:1].isupper() for w in span.split()) >= 1 + (kind == "name") else -1
    if kind == "phone":
        return 1 if 8 <= len(digits) <= 15 and not _DOTTED.match(span) else -1
    if kind == "email":
        return 1 if span.count("@") == 1 and "." in span.partition("@")[2] and ".." not in span else -1
    if kind in ("key", "secret"):
        many = len(set(span)) >= max(4, min(12, len(span) // 2))
        return 1 if many and digits and len(digits) < len(span) else -1
    return -1


def valid_v6(span: str) -> bool:
    parts = span.split(":")
    return span.count("::") <= 1 and ":::" not in span and all(len(p) <= 4 for p in parts) and (len(parts) == 8 if "::" not in span else len(parts) <= 8)


def mod_97(span: str) -> bool:
    """The check digits of an account number."""
    s = re.sub(r"[ -]", "", span)
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def national(span: str) -> int:
    """Check letters and digits of national numbers, where there are any."""
    s = re.sub(r"[ -]", "", span)
    if re.match(r"[\dXYZ]\d{7}[A-Z]$", s):
        return 1 if "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == s[-1] else -1
    if len(s) == 15 and s.isdigit():
        return 1 if 97 - int(s[:13]) % 97 == int(s[13:]) else -1
    return 0


def _gazetteer(kind: str, span: str) -> int:
    if kind == "email":
        return 1 if span.rpartition(".")[2].lower() in TOP_LEVEL else -1
    if kind == "phone":
        code = re.match(r"\+(\d{1,3})(?=[ .()-])|\+(\d)", span)
        return 0 if not code else 1 if (code[1] or code[2]) in COUNTRY_CODES or code[2] else -1
    if kind == "card":
        return 1 if span.startswith(ISSUERS) else -1
    if kind == "ip":
        return -1 if span.split(".")[0] in ("0", "127", "255") else 1
    if kind == "iban":
        return 1 if span[:2] in IBAN_COUNTRIES else -1
    if kind == "national":
        return 1 if _STRICT["national"].match(span) else -1
    if kind in ("address", "name"):
        return 0 if kind == "name" and not TITLES.isdisjoint(span.split()) else 1
    if kind == "key":
        return 1 if span.startswith(KEY_PREFIXES) else 0
    if kind == "secret":
        return -1 if span.lower().strip("<>[]{}") in NOT_SECRETS or span.lower().startswith("your") else 0
    return -1


def _before(kind: str, left: str) -> int:
    return -1 if _AGAINST.search(left) else 1 if _CUES[kind].search(left) else 0


def _runs_on(kind: str, span: str, left: str, right: str) -> bool:
    """Whether one more group of digits stands beside a phone number, as where it is a part of a card's."""
    return kind == "phone" and bool(re.match(r"[ .-]\d+(?!\w|\.\d)", right) or span[0] != "+" and re.search(r"(?<![\w.])\d{1,7}[ .-]$", left))


def _beside(kind: str, span: str, left: str, right: str) -> int:
    """Whether the span stands alone, or is part of something longer."""
    a, b = left[-1:] or " ", right[:1] or " "
    if _runs_on(kind, span, left, right):
        return -1
    return 1 if (a.isspace() or a in "\"'(<[=:,;") and (b.isspace() or b in "\"')>].,;:!?") else -1


LABELERS = ("regex", "check", "gazetteer", "before", "beside")


def _clip(n: int, *edges: int) -> int:
    return sum(n >= e for e in edges)


def features(kind: str, span: str, left: str, right: str) -> tuple[int, ...]:
    """A few small numbers on the span's form and neighbours."""
    n = len(span)
    digits, upper = sum(c.isdigit() for c in span), sum(c.isupper() for c in span)
    letters = sum(c.isalpha() for c in span)
    return (KINDS.index(kind), _clip(n, 4, 8, 12, 16, 20, 32), _clip(digits, 1, 4, 7, 10, 13, 17), int(4 * digits / n), int(2 * upper / max(1, letters)), _clip(sum(not c.isalnum() for c in span), 1, 2, 3, 5), (left[-1:] or " ").isalnum() + 2 * _runs_on(kind, span, left, right), int(_before(kind, left)) + 1, int(_checks(kind, span)) + 1)


def candidates(text: str, begin: int, end: int) -> Iterator[tuple[int, int, str, tuple[int, ...], tuple[int, ...]]]:
    """(begin, end, kind, votes, features) of all that any form finds within one region of a text; they may overlap."""
    region = text[begin:end]
    for kind, form, group in _FORMS:
        for m in form.finditer(region):
            a, b = m.span(group)
            a, b = a + begin, b + begin
            span, left, right = text[a:b], text[max(0, a - 32) : a], text[b : b + 8]
            yield a, b, kind, (_regex(kind, span), _checks(kind, span), _gazetteer(kind, span), _before(kind, left), _beside(kind, span, left, right)), features(kind, span, left, right)


def regions(texts: list[str]) -> Iterator[tuple[int, int, int]]:
    """(text, begin, end) of the parts that hold a digit, @, = or :, with whole words and some characters on either side."""
    arr = code_points("\n".join(texts))
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    mark = np.flatnonzero(_MARKS[arr])
    if not len(mark):
        return
    space = np.concatenate(([-1], np.flatnonzero(_SPACE[arr]), [len(arr)]))
    owner = np.searchsorted(start, mark, side="right") - 1
    # out to the white space beyond so many characters
    lo = space[np.maximum(0, np.searchsorted(space, mark - _AROUND, side="right") - 1)] + 1
    hi = space[np.minimum(len(space) - 1, np.searchsorted(space, mark + _AROUND, side="left"))]
    lo, hi = np.maximum(lo, start[owner]), np.minimum(hi, start[owner] + size[owner])
    new = np.ones(len(mark), bool)
    new[1:] = (lo[1:] > hi[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(mark)) - 1
    top = np.maximum.reduceat(hi, first)
    for o, a, b, _ in zip(owner[first].tolist(), lo[first].tolist(), top.tolist(), last.tolist()):
        yield o, a - int(start[o]), b - int(start[o])


def _found(texts: list[str]) -> Iterator[tuple[int, int, int, str, tuple[int, ...], tuple[int, ...]]]:
    for part in text_blocks(texts):
        some = [t or "" for t in texts[part]]
        for o, a, b in regions(some):
            for x in candidates(some[o], a, b):
                yield part.start + o, *x


def _code(numbers: tuple[int, ...]) -> str:
    return ",".join(map(str, numbers))


def patterns(docs: DataFrame) -> DataFrame:
    """(kind, votes, features, n): how often each pattern occurs in the corpus."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("kind", pa.string()), ("votes", pa.string()), ("features", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        seen: Counter = Counter()
        for batch in batches:
            for _, texts in text_parts(batch, 0):
                for _, _, _, kind, votes, form in _found(texts):
                    seen[kind, _code(votes), _code(form)] += 1
        columns = list(zip(*((*k, n) for k, n in seen.items()))) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return docs.select("text").mapInArrow(tidy(run), "kind string, votes string, features string, n long").groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))


def reliabilities(kind: np.ndarray, votes: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern, and P(vote | true or false) of each labeler: EM from the majority's view.

    Pseudo-counts say that a labeler is rather right than wrong, and that a
    kind may be true or false.
    """
    m = votes.shape[1]
    total = votes.sum(1)
    q = 1 / (1 + np.exp(-1.5 * total))
    prior_counts = np.array([[1.0, 2.0, 4.0], [4.0, 2.0, 1.0]])  # true: no, abstains, yes; false: the same
    table = np.zeros((2, m, 3))
    for _ in range(rounds):
        for y, w in enumerate((q * weight, (1 - q) * weight)):
            for j in range(m):
                c = prior_counts[y] + np.bincount(votes[:, j] + 1, w, 3)
                table[y, j] = c / c.sum()
        share = np.array([((q * weight)[kind == k].sum() + 1) / (weight[kind == k].sum() + 2) for k in range(len(KINDS))])
        lift = np.log(share[kind] / (1 - share[kind]))
        for j in range(m):
            lift = lift + np.log(table[0, j, votes[:, j] + 1] / table[1, j, votes[:, j] + 1])
        new = 1 / (1 + np.exp(-np.clip(lift, -30, 30)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return q, table


class SpanClassifier:
    """Logistic regression on one-hot features, of which each is crossed with the kind."""

    def __init__(self, form: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0):
        self.index: dict[tuple[int, int, int], int] = {}
        for row in form.tolist():
            for cell in self._cells(row):
                self.index.setdefault(cell, len(self.index))
        x = self._matrix(form)
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weight * (target - p)) - ridge * w
            h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(x.shape[1])
            step = np.linalg.solve(h, g)
            w += step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        self.known: dict[tuple[int, ...], float] = {}

    @staticmethod
    def _cells(row) -> list[tuple[int, int, int]]:
        return [(row[0], j, v) for j, v in enumerate(row)]

    def _matrix(self, form: np.ndarray) -> np.ndarray:
        x = np.zeros((len(form), len(self.index)))
        for i, row in enumerate(form.tolist()):
            for cell in self._cells(row):
                if cell in self.index:
                    x[i, self.index[cell]] = 1
        return x

    def probability(self, form: tuple[int, ...]) -> float:
        p = self.known.get(form)
        if p is None:
            s = sum(self.w[self.index[c]] for c in self._cells(form) if c in self.index)
            p = self.known[form] = float(1 / (1 + np.exp(-np.clip(s, -30, 30))))
        return p


def fit(docs: DataFrame) -> SpanClassifier | None:
    """The span classifier of a corpus; None if it has no candidates."""
    rows = materialise(patterns(docs), "patterns").collect()
    if not rows:
        return None
    rows.sort()
    kind = np.array([KINDS.index(r["kind"]) for r in rows])
    votes = np.array([[int(x) for x in r["votes"].split(",")] for r in rows])
    form = np.array([[int(x) for x in r["features"].split(",")] for r in rows])
    weight = np.array([r["n"] for r in rows], float)
    q, _ = reliabilities(kind, votes, weight)
    return SpanClassifier(form, q, weight)


def resolve(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Of accepted spans of one text, those that stay: none that lies within a longer one, then by probability (in tenths), length and form."""
    order = {kind: k for k, (kind, _, _) in enumerate(_FORMS)}
    outer: list[tuple[int, int, str, float]] = []
    reach = -1
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[1] > reach or outer and x[:2] == outer[-1][:2]:
            outer.append(x)
            reach = max(reach, x[1])
    stay: list[tuple[int, int, str, float]] = []  # in order, without overlaps
    for a, b, kind, p in sorted(outer, key=lambda x: (-round(x[3], 1), x[0] - x[1], order[x[2]], x[0])):
        # what a better one leaves of a span is still hidden
        for x, y in _gaps(stay, a, b):
            insort(stay, (x, y, kind, p))
    return stay


def _gaps(taken: list[tuple[int, int, str, float]], a: int, b: int) -> list[tuple[int, int]]:
    """What of a to b isn't taken; taken is in order and without overlaps."""
    out, at = [], a
    k = max(0, bisect_left(taken, (a,)) - 1)
    while at < b and k < len(taken) and taken[k][0] < b:
        x, y = taken[k][:2]
        if x > at:
            out.append((at, x))
        at, k = max(at, y), k + 1
    if at < b:
        out.append((at, b))
    return out


def _decided(texts: list[str], model: SpanClassifier, threshold: float) -> Iterator[tuple[int, int, int, str, float]]:
    for row, own in groupby(_found(texts), key=lambda x: x[0]):
        accepted = [(a, b, kind, p) for _, a, b, kind, _, form in own if (p := model.probability(form)) >= threshold]
        for a, b, kind, p in resolve(accepted) if len(accepted) > 1 else accepted:
            yield row, a, b, kind, p


def spans(docs: DataFrame, model: SpanClassifier | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, begin, end, kind, probability) of each span of personal data or secret; places count characters from 0.

    Trained on docs unless a model is given.  A null or empty text has no
    spans; texts and words of any length are searched whole, in linear time.
    A probability that equals the threshold counts; where accepted spans
    overlap, one that lies within another gives way, then the less probable,
    the shorter and the later form; null ids stay null; rows that repeat give their spans each time; an
    empty table gives no spans.  Columns other than doc_id and text are not
    looked at.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("probability", pa.float64())])
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is None:
                return
            ids = batch.column(0).to_pylist()
            rows = [(ids[part.start + row], a, b, kind, round(p, 6)) for part, texts in text_parts(batch, 1) for row, a, b, kind, p in _decided(texts, shared.value, threshold)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, schema.types)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, begin int, end int, kind string, probability double")


def redact(docs: DataFrame, model: SpanClassifier | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets and n_chars, where there is one, set anew; all columns stay.

    Null and empty texts, null ids and other columns stay as they are; every
    row is judged by its own text, repeated ones each; an empty table stays
    empty.  As to overlaps, ties and long texts it is as `spans`.
    """
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    sized = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is None:
                yield batch
                continue
            texts = batch.column(at).to_pylist()
            found: dict[int, list[tuple[int, int, str]]] = {}
            for row, a, b, kind, _ in _decided(texts, shared.value, threshold):
                found.setdefault(row, []).append((a, b, kind))
            for row, own in found.items():
                old, done, out = texts[row], 0, []
                for a, b, kind in sorted(own):
                    out += [old[done:a], f"<{kind.upper()}>"]
                    done = b
                texts[row] = "".join(out) + old[done:]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.types[at])
            if sized is not None and found:
                counts = batch.column(sized).to_pylist()
                for row in found:
                    counts[row] = len(texts[row])
                columns[sized] = pa.array(counts, batch.schema.types[sized])
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(run), docs.schema)
