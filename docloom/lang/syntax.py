"""Tokens, syntax tree and recursive-descent parser of the pipe language.

    query    := primary { "|" primary } end
    primary  := selector | NAME "(" args ")" | NAME | "(" query ")" | STRING | NUMBER, then { "[" index "]" }
    selector := "." NAME [ "(" args ")" ]        select and filter take one condition, map one expression
    args     := [ cmp { "," cmp } ]
    cmp      := logic [ ("==" | "!=" | "<" | "<=" | ">" | ">=") logic ]
    logic    := prop { ("and" | "or") prop }     binds tighter than a comparison
    prop     := ["!" | "-"] ["."] NAME [ "(" args ")" ] { "[" index "]" } | STRING | NUMBER | "(" cmp ")"
    index    := prop | prop ":" [prop] | ":" prop
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import lru_cache


class QueryError(ValueError):
    """A query that can't be read or doesn't make sense."""


@dataclass(frozen=True)
class Token:
    kind: str
    value: object
    at: int


@dataclass(frozen=True)
class Node:
    def parts(self) -> tuple[Node, ...]:
        """The nodes right below, in the order of the text."""
        values = [getattr(self, f.name) for f in fields(self)]
        return tuple(x for v in values for x in (v if isinstance(v, tuple) else (v,)) if isinstance(x, Node))

    def walk(self) -> Iterator[Node]:
        """This node and all below it, from the top down."""
        yield self
        for x in self.parts():
            yield from x.walk()

    def accept(self, visitor: object) -> object:
        """What the visitor's method for this kind of node (visit_pipe, visit_selector and so on) gives, or its visit for kinds that it has none for."""
        own = getattr(visitor, f"visit_{type(self).__name__.lower()}", None) or getattr(visitor, "visit", None)
        if own is None:
            raise QueryError(f"the visitor can't take a {type(self).__name__}")
        return own(self)


@dataclass(frozen=True)
class Pipe(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Selector(Node):
    name: str
    args: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Filter(Node):
    condition: Node


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node


@dataclass(frozen=True)
class Literal(Node):
    value: object


@dataclass(frozen=True)
class Name(Node):
    name: str


@dataclass(frozen=True)
class Index(Node):
    of: Node
    index: Node


@dataclass(frozen=True)
class Slice(Node):
    of: Node
    start: Node | None
    end: Node | None


_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<op>==|!=|<=|>=|[<>|.(),\[\]:!-])|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")


def tokens(query: str) -> list[Token]:
    out, i = [], 0
    while i < len(query):
        m = _TOKEN.match(query, i)
        if not m:
            line = query.count("\n", 0, i) + 1
            raise QueryError(f"line {line}, column {i - query.rfind(chr(10), 0, i)}: unexpected {query[i]!r}")
        kind, text = m.lastgroup, m[0]
        if kind == "number":
            out.append(Token(kind, float(text) if "." in text else int(text), i))
        elif kind == "string":
            out.append(Token(kind, re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1]), i))
        elif kind == "name":
            out.append(Token("op" if text in ("and", "or") else kind, text, i))
        elif kind == "op":
            out.append(Token(kind, text, i))
        i = m.end()
    return [*out, Token("end", None, len(query))]


class _Parser:
    def __init__(self, query: str):
        self.query, self.tokens, self.i = query, tokens(query), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def fail(self, wanted: str) -> QueryError:
        at = self.now.at
        line = self.query.count("\n", 0, at) + 1
        return QueryError(f"line {line}, column {at - self.query.rfind(chr(10), 0, at)}: expected {wanted}, found {self.now.value if self.now.kind != 'end' else 'the end'!r}")

    def take(self, *ops: str) -> str | None:
        if self.now.kind == "op" and self.now.value in ops:
            self.i += 1
            return str(self.tokens[self.i - 1].value)
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise self.fail(repr(op))

    def name(self) -> str:
        if self.now.kind != "name":
            raise self.fail("a name")
        self.i += 1
        return str(self.tokens[self.i - 1].value)

    def whole(self) -> Node:
        out = self.query_()
        if self.now.kind != "end":
            raise self.fail("the end or '|'")
        return out

    def query_(self) -> Node:
        out = self.primary()
        while self.take("|"):
            out = Pipe(out, self.primary())
        return out

    def literal(self) -> Literal | None:
        if self.now.kind in ("string", "number"):
            self.i += 1
            return Literal(self.tokens[self.i - 1].value)
        return None

    def primary(self) -> Node:
        out: Node | None = self.literal()
        if out is None:
            if self.take("."):
                name = self.name()
                out = self.called(name, True)
            elif self.take("("):
                out = self.query_()
                self.need(")")
            elif self.now.kind == "name":
                out = self.called(self.name(), False)
            else:
                raise self.fail("a selector, a function or a value")
        return self.indexed(out)

    def called(self, name: str, dotted: bool) -> Node:
        args = self.args() if self.take("(") else None
        if name in ("select", "filter") and args is not None:
            if len(args) != 1:
                raise QueryError(f"{name} takes one condition")
            return Filter(args[0])
        if dotted and name != "map":
            return Selector(name, args or ())
        return Name(name) if args is None else Call(name, args)

    def args(self) -> tuple[Node, ...]:
        out: list[Node] = []
        if not self.take(")"):
            out.append(self.cmp())
            while self.take(","):
                out.append(self.cmp())
            self.need(")")
        return tuple(out)

    def cmp(self) -> Node:
        left = self.logic()
        op = self.take(*COMPARISONS)
        return Binary(op, left, self.logic()) if op else left

    def logic(self) -> Node:
        out = self.prop()
        while op := self.take("and", "or"):
            out = Binary(op, out, self.prop())
        return out

    def prop(self) -> Node:
        if op := self.take("!", "-"):
            inner = self.prop()
            if op == "-" and isinstance(inner, Literal) and isinstance(inner.value, (int, float)):
                return Literal(-inner.value)
            return Unary(op, inner)
        out: Node | None = self.literal()
        if out is None:
            if self.take("("):
                out = self.cmp()
                self.need(")")
            elif self.take("."):
                out = self.called(self.name(), True)
            elif self.now.kind == "name":
                out = self.called(self.name(), False)
            else:
                raise self.fail("a value")
        return self.indexed(out)

    def indexed(self, out: Node) -> Node:
        while self.take("["):
            start = None if self.now == Token("op", ":", self.now.at) else self.prop()
            if self.take(":"):
                end = None if self.now == Token("op", "]", self.now.at) else self.prop()
                if start is None and end is None:
                    raise self.fail("a bound")
                out = Slice(out, start, end)
            else:
                out = Index(out, start)
            self.need("]")
        return out


@lru_cache(maxsize=512)
def parse(query: str) -> Node:
    """The syntax tree of a query; trees are kept by query."""
    return _Parser(query).whole()
