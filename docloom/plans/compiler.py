"""Compiles the pipe language into lazy DataFrame plans.

A relation is an array of each document's nested row: selectors, conditions,
parts and properties become higher-order functions over it, and only the last
step makes rows of what is left.  So a query parses each document once and
shuffles nothing.  Properties and kinds are checked before anything runs.  A
query runs over a whole corpus; a document's rows come in its own order, and
documents in any, unless the result is asked for in order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from docloom.lang.syntax import COMPARISONS, Binary, Call, Filter, Index, Literal, Name, Node, Pipe, QueryError, Selector, Slice, Unary, parse
from docloom.operators import structure
from docloom.plans.corpus import INFO, Corpus
from docloom.sources.structure import ELEMENTS

#: Properties of each kind: column and type; a type in angle brackets is a kind.
PROPERTIES = {
    "headings": {"text": ("text", "string"), "level": ("level", "int"), "id": ("id", "string"), "line": ("line", "int")},
    "sections": {"text": ("text", "string"), "heading": ("title", "<headings>"), "children": ("", "<sections>"), "start": ("start_line", "int"), "end": ("end_line", "int"), "title": ("title", "string"), "level": ("level", "int")},
    "code": {"content": ("content", "string"), "text": ("content", "string"), "language": ("language", "string"), "lines": ("lines", "int")},
    "links": {"text": ("text", "string"), "url": ("url", "string")},
    "images": {"text": ("alt_text", "string"), "alttext": ("alt_text", "string"), "alt": ("alt_text", "string"), "url": ("url", "string"), "title": ("title", "string")},
    "tables": {"headers": ("headers", "array"), "rows": ("rows", "array")},
    "lists": {"ordered": ("ordered", "bool")},
    "document": {"text": ("readable_text", "string"), "title": ("title", "string"), "path": ("path", "string"), "format": ("format", "string")},
    "search": {"section": ("section", "string"), "lines": ("lines", "string"), "match": ("match", "string"), "level": ("level", "int"), "text": ("match", "string")},
    "tree": {"text": ("text", "string"), "level": ("level", "int")},
}
_TEXT = {"headings": "text", "sections": "text", "code": "content", "links": "text", "images": "alt_text", "document": "readable_text", "values": "value", "search": "match"}
SELECTORS = ("headings", "section", "sections", "code", "links", "images", "tables", "lists", "metadata", "owner", "tags", "priority", "text", "length", "tree", "search")


#: Gives a column of the row, or a field of the element, that a condition is on.
Field = Callable[[str], Column]


class _Lines:
    """The lines of the document, and whether they were asked for."""

    def __init__(self, column: Column):
        self._column, self.used = column, False

    @property
    def column(self) -> Column:
        self.used = True
        return self._column


@dataclass(frozen=True)
class Relation:
    """Of each document an array: elements of the kind, or values of the type named; items makes it, given the document's lines."""

    kind: str
    corpus: Corpus
    items: Callable[[_Lines], Column]
    type: str = ""
    must: bool = False  # in a query on one document, no rows are an error

    def array(self, finished: bool = False) -> Column:
        def make(lines: _Lines) -> Column:
            out = self.items(lines)
            if finished and self.kind == "sections":
                names = ELEMENTS["sections"].names
                out = F.transform(out, lambda s: F.struct(*(s[c].alias(c) for c in names), structure.section_text(s, lines.column).alias("text")))
            return out

        trial = _Lines(F.split("source", "\n"))
        plain = make(trial)
        return structure.with_lines(lambda ls: make(_Lines(ls))) if trial.used else plain

    def numbered(self) -> DataFrame:
        """(doc_id, ord, columns of the kind, or value)."""
        if self.kind == "document":
            return self.corpus.documents.withColumn("ord", F.lit(0))
        rows = self.corpus.parsed.select("doc_id", F.posexplode(self.array(finished=True)).alias("ord", "e"))
        return rows.select("doc_id", "ord", F.col("e").alias("value") if self.kind == "values" else F.col("e.*"))

    def rows(self, order: bool = False) -> DataFrame:
        """The rows; with order those of all documents in one order, which takes a sort of everything."""
        rows = self.numbered()
        return (rows.orderBy("doc_id", "ord") if order else rows).drop("ord")


class Compiler:
    def __init__(self, corpus: Corpus, variables: dict[str, object] | None = None):
        self.corpus, self.variables = corpus, variables or {}

    def start(self) -> Relation:
        return self._relation("document", lambda ls: F.array(F.struct(*(F.col(c) for c in (*INFO, "source")))))

    def _relation(self, kind: str, items: Callable[[_Lines], Column], type: str = "", must: bool = False) -> Relation:  # noqa: A002
        return Relation(kind, self.corpus, items, type, must)

    def _field(self, now: Relation, element: Column, lines: _Lines) -> Field:
        if now.kind == "values":
            return lambda name: element
        if now.kind == "sections":
            return lambda name: structure.section_text(element, lines.column) if name == "text" else element[name]
        return lambda name: element[name]

    def _mapped(self, now: Relation, make: Callable[[Field], Column]) -> Callable[[_Lines], Column]:
        return lambda ls: F.transform(now.items(ls), lambda e: make(self._field(now, e, ls)))

    # -- relations

    def run(self, node: Node, now: Relation | None = None) -> Relation:
        now = now or self.start()
        if isinstance(node, Pipe):
            return self.run(node.right, self.run(node.left, now))
        if isinstance(node, Selector):
            return self.select(node, now)
        if isinstance(node, Filter):
            return self.filter(node.condition, now)
        if isinstance(node, (Index, Slice)):
            return self.part(node, now)
        if isinstance(node, Call) and node.name == "map":
            if len(node.args) != 1:
                raise QueryError("map takes one expression")
            return self.map(node.args[0], now)
        if isinstance(node, Call) and node.name == "length":
            return self.length(now)
        return self.map(node, now)

    def map(self, node: Node, now: Relation) -> Relation:
        """An expression of each row; a property that is itself an element gives elements."""
        if isinstance(node, Selector) and now.kind in PROPERTIES and node.name in PROPERTIES[now.kind] and not node.args:
            return self.property(node.name, now)
        _, kind = self.expression(node, now, F.col)
        return self._relation("values", self._mapped(now, lambda at: self.expression(node, now, at)[0]), kind)

    def property(self, name: str, now: Relation) -> Relation:
        column, kind = PROPERTIES[now.kind][name]
        if kind == "<headings>":
            return self._relation("headings", self._mapped(now, lambda at: F.struct(at("pos").alias("pos"), at("level").alias("level"), at("title").alias("text"), F.lit("").alias("id"), at("start_line").alias("line"))))
        if kind == "<sections>":
            return self._relation("sections", lambda ls: F.flatten(F.transform(now.items(ls), structure.children_of)))
        return self._relation("values", self._mapped(now, lambda at: at(column)), kind)

    def constants(self, node: Selector, kind: type | tuple) -> list:
        """Arguments of the wanted type; others are left out."""
        values = []
        for a in node.args:
            if isinstance(a, Name) and a.name in self.variables:
                a = Literal(self.variables[a.name])
            if isinstance(a, Name) and a.name in ("true", "false"):
                a = Literal(a.name == "true")
            if isinstance(a, Literal) and isinstance(a.value, kind) and (kind is bool or not isinstance(a.value, bool)):
                values.append(a.value)
        return values

    def picked(self, name: str, column: str, values: list) -> Relation:
        """Elements whose column is one of the values, in the order of the values."""
        array = self._elements(name)

        def those(value) -> Column:  # a second parameter of the lambda would be the place of the element
            return F.filter(array, lambda e: e[column] == value)

        parts = [those(v) for v in values]
        return self._relation(name, lambda ls: F.concat(*parts) if len(parts) > 1 else parts[0])

    def _elements(self, kind: str) -> Column:
        name = "code_blocks" if kind == "code" else kind
        if name not in self.corpus.want:
            raise ValueError(f"{name} were not asked for when the corpus was read")
        return F.coalesce(F.col(name), F.array().cast(ArrayType(ELEMENTS[name])))

    def select(self, node: Selector, now: Relation) -> Relation:
        name, args, c = node.name, node.args, self.corpus
        if not args and now.kind in PROPERTIES and name in PROPERTIES[now.kind] and (now.kind != "document" or name == "text"):
            return self.property(name, now)
        if name == "headings":
            levels = [v for v in self.constants(node, int) if 1 <= v <= 6]
            array = self._elements("headings")
            if args:
                return self.picked("headings", "level", levels) if levels else self._relation("headings", lambda ls: F.filter(array, lambda e: F.lit(False)))
            by = F.array_sort(F.transform(array, lambda h: F.struct(h["level"].alias("a"), h["pos"].alias("b"), h.alias("h"))))
            return self._relation("headings", lambda ls: F.transform(by, lambda x: x["h"]))
        if name in ("section", "sections"):
            titles, array = self.constants(node, str), self._elements("sections")
            if name == "section" and not titles:
                raise QueryError("section takes a title")
            return self._relation("sections", lambda ls: F.filter(array, lambda s: s["indexed"] & (s["title"] == titles[0]) if name == "section" else s["indexed"]), must=name == "section")
        if name == "code":
            languages = self.constants(node, str)
            array = self._elements("code")
            if now.kind == "sections":

                def blocks(ls: _Lines) -> Column:
                    held = F.array_sort(F.array_distinct(F.flatten(F.transform(now.items(ls), structure.code_of))))
                    return F.filter(held, lambda b: b["language"].isin(*languages)) if languages else held

                return self._relation("code", blocks)
            return self.picked("code", "language", languages) if languages else self._relation("code", lambda ls: array)
        if name in ("links", "images", "tables"):
            array = self._elements(name)
            return self._relation(name, lambda ls: array)
        if name == "lists":
            ordered, array = self.constants(node, bool), self._elements("lists")
            return self._relation("lists", lambda ls: F.filter(array, lambda e: e["ordered"] == ordered[0]) if ordered else array)
        if name in ("metadata", "owner", "priority", "tags"):
            value = F.col("metadata") if name == "metadata" else c.tags() if name == "tags" else c.metadata(name)
            array = F.array(F.coalesce(value, F.lit("")) if name == "priority" else value)
            return self._relation("values", lambda ls: F.filter(array, lambda v: v.isNotNull()) if name == "owner" else array, "array" if name == "tags" else "string", must=name == "owner")
        if name == "text":
            if now.kind not in _TEXT:
                raise QueryError(f"{now.kind} have no text")
            return self._relation("values", self._mapped(now, lambda at: at(_TEXT[now.kind])), "string")
        if name == "length":
            return self.length(now)
        if name == "tree":
            mode = (self.constants(node, str) or [""])[0]
            self._elements("sections"), None if mode else self._elements("code")
            if mode not in structure.MODES:
                raise QueryError(f"no such mode: {mode!r}")
            return self._relation("tree", lambda ls: structure.outline(mode, ls.column if mode in ("preview", "full") else F.array(), now.items(ls) if now.kind == "sections" else None))
        if name == "search":
            terms = self.constants(node, str)
            if not terms:
                raise QueryError("search takes a term")
            self._elements("sections")
            return self._relation("search", lambda ls: structure.found(terms[0], ls.column))
        known = PROPERTIES.get(now.kind, {})
        if any(name in p for p in PROPERTIES.values()):
            raise QueryError(f"{now.kind} have no {name}" + (f"; they have {', '.join(known)}" if known else ""))
        raise QueryError(f"unknown selector {name}")

    def filter(self, condition: Node, now: Relation) -> Relation:
        self.truth(*self.expression(condition, now, F.col))
        return replace(now, items=lambda ls: F.filter(now.items(ls), lambda e: self.truth(*self.expression(condition, now, self._field(now, e, ls)))))

    def length(self, now: Relation) -> Relation:
        """Of a collection, its rows in each document; of strings, their bytes; of arrays, their items."""
        if now.kind == "document" or (now.kind == "values" and now.type in ("string", "array")):
            return self.map(Call("length"), now)
        return self._relation("values", lambda ls: F.array(F.size(now.items(ls))), "int")

    def part(self, node: Index | Slice, now: Relation) -> Relation:
        of = self.run(node.of, now)
        if of.kind == "values" and of.type in ("array", "string"):
            _, kind = self._part(node, F.col("value"), of.type)
            return self._relation("values", self._mapped(of, lambda at: self._part(node, at("value"), of.type)[0]), kind)
        if isinstance(node, Index):
            at = self._whole(node.index)
            return replace(of, items=lambda ls: F.slice(of.items(ls), max(0, at) + 1, 1 if at >= 0 else 0), must=True)
        start, end = (None if x is None else self._whole(x) for x in (node.start, node.end))
        return self.between(of, start or 0, end)

    def between(self, now: Relation, start: int, end: int | None) -> Relation:
        """The rows of each document from start to before end."""
        start = max(0, start)
        return replace(now, items=lambda ls: F.slice(now.items(ls), start + 1, 2**31 - 2 - start if end is None else max(0, end - start)))

    def _whole(self, node: Node | None) -> int:
        if isinstance(node, Name) and node.name in self.variables:
            node = Literal(self.variables[node.name])
        if not isinstance(node, Literal) or isinstance(node.value, (str, bool)):
            raise QueryError("an index is a number")
        return int(node.value)

    def _part(self, node: Index | Slice, value: Column, kind: str) -> tuple[Column, str]:
        item = "string" if kind == "string" else ""
        if isinstance(node, Index):
            at = self._whole(node.index)
            if kind == "string":
                return F.when((F.lit(at) >= 0) & (F.length(value) > at), F.substring(value, at + 1, 1)), item
            return F.get(value, F.lit(at)), item
        start, end = (None if x is None else self._whole(x) for x in (node.start, node.end))
        start = max(0, start or 0)
        size = F.length(value) if kind == "string" else F.size(value)
        n = F.greatest(F.least(size, F.lit(end)) - start if end is not None else size - start, F.lit(0))
        return (F.substring(value, F.lit(start + 1), n) if kind == "string" else F.slice(value, start + 1, n)), kind

    # -- expressions of one row: column and type

    def expression(self, node: Node, now: Relation, at: Field) -> tuple[Column, str]:
        if isinstance(node, Literal):
            v = node.value
            return F.lit(v), "bool" if isinstance(v, bool) else "string" if isinstance(v, str) else "literal" if isinstance(v, int) else "float"
        if isinstance(node, Name):
            if node.name in self.variables:
                return self.expression(Literal(self.variables[node.name]), now, at)
            if node.name in ("true", "false"):
                return F.lit(node.name == "true"), "bool"
            return self._property(node.name, now, at)
        if isinstance(node, Selector) and not node.args:
            if node.name == "length" and not (now.kind in PROPERTIES and "length" in PROPERTIES[now.kind]):
                return self.expression(Call("length"), now, at)
            return self._property(node.name, now, at)
        if isinstance(node, Call):
            return self._call(node, now, at)
        if isinstance(node, Unary):
            value, kind = self.expression(node.operand, now, at)
            if node.op == "!":
                return ~self.truth(value, kind), "bool"
            if kind not in ("int", "literal", "float"):
                raise QueryError("only numbers can be negated")
            return -value, kind
        if isinstance(node, Binary):
            a, b = self.expression(node.left, now, at), self.expression(node.right, now, at)
            if node.op in ("and", "or"):
                x, y = self.truth(*a), self.truth(*b)
                return (x & y if node.op == "and" else x | y), "bool"
            return self._compare(node.op, a, b), "bool"
        if isinstance(node, (Index, Slice)):
            value, kind = self.expression(node.of, now, at)
            if kind not in ("array", "string"):
                raise QueryError(f"{kind or 'this'} has no parts")
            return self._part(node, value, kind)
        raise QueryError(f"{type(node).__name__} can't stand in an expression")

    def _property(self, name: str, now: Relation, at: Field) -> tuple[Column, str]:
        if now.kind == "values" and name in ("text", "value"):
            return at("value"), now.type
        column, kind = PROPERTIES.get(now.kind, {}).get(name, (None, ""))
        if column is None:
            raise QueryError(f"{now.kind} have no {name}")
        if kind == "<sections>":
            raise QueryError("children can't stand in a condition")
        return at(column), "string" if kind.startswith("<") else kind

    def _call(self, node: Call, now: Relation, at: Field) -> tuple[Column, str]:
        name, args = node.name, node.args
        if name in ("contains", "startswith", "endswith"):
            # on the row's text, or on a first argument of its own
            if len(args) not in (1, 2):
                raise QueryError(f"{name} takes one argument, or a text and a part of it")
            if len(args) == 1 and now.kind not in _TEXT:
                raise QueryError(f"{now.kind} have no text")
            value, kind = self.expression(args[0], now, at) if len(args) == 2 else (at(_TEXT[now.kind]), "string")
            part, of = self.expression(args[-1], now, at)
            text = value.cast("string") if kind != "array" else F.array_join(value, " ")
            return getattr(F, name)(text, part.cast("string") if of != "string" else part), "bool"
        if name == "length":
            if len(args) > 1:
                raise QueryError("length takes one argument at most")
            value, kind = self.expression(args[0], now, at) if args else (at(_TEXT[now.kind]), now.type if now.kind == "values" else "string") if now.kind in _TEXT else (F.lit(0), "int")
            return (F.octet_length(value) if kind == "string" else F.size(value) if kind == "array" else F.lit(0)), "int"
        if name in PROPERTIES.get(now.kind, {}) and not args:
            return self._property(name, now, at)
        raise QueryError(f"unknown function {name}")

    @staticmethod
    def _compare(op: str, a: tuple[Column, str], b: tuple[Column, str]) -> Column:
        numbers = ("int", "literal", "float")
        (x, s), (y, t) = a, b
        both = s in numbers and t in numbers
        if both:
            x, y = x.cast("double"), y.cast("double")
        elif s != t:
            if op == "==":
                return F.lit(False)
            if op == "!=":
                return F.lit(True)
            raise QueryError(f"{s} and {t} can't be ordered")
        elif op not in ("==", "!=") and s != "string":
            raise QueryError(f"{s} can't be ordered")
        assert op in COMPARISONS
        return {"==": x.eqNullSafe(y), "!=": ~x.eqNullSafe(y)}[op] if op in ("==", "!=") else {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    @staticmethod
    def truth(value: Column, kind: str) -> Column:
        """Empty, zero and null are false; a whole number written in the query is true, even 0."""
        if kind == "literal":
            return F.lit(True)
        test = value if kind == "bool" else value != "" if kind == "string" else F.size(value) > 0 if kind == "array" else value != 0
        return F.coalesce(test, F.lit(False))


def compile(corpus: Corpus, query: str | Node, variables: dict[str, object] | None = None) -> Relation:  # noqa: A001
    """The relation of a query over a corpus; nothing runs yet."""
    return Compiler(corpus, variables).run(parse(query) if isinstance(query, str) else query)


def query(corpus: Corpus, text: str, variables: dict[str, object] | None = None, order: bool = False) -> DataFrame:
    """Rows of a query over a corpus; with order in that of documents and of their parts."""
    return compile(corpus, text, variables).rows(order)


def query_one(corpus: Corpus, text: str, variables: dict[str, object] | None = None) -> DataFrame:
    """The same for a corpus of one document, where a section, an owner or an index that isn't there is an error."""
    node = parse(text)
    compiler = Compiler(corpus, variables)
    steps: list[Node] = []
    while isinstance(node, Pipe):
        steps.append(node.right)
        node = node.left
    now = compiler.run(node)
    for step in [None, *reversed(steps)]:
        now = compiler.run(step, now) if step is not None else now
        if now.must and now.numbered().isEmpty():
            raise QueryError(f"nothing found by {node if step is None else step}")
    return now.rows(order=True)
