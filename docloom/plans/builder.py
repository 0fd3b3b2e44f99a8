"""Fluent queries: each method gives another lazy builder."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.lang.syntax import Literal, QueryError, Selector
from docloom.plans.compiler import Compiler, Relation
from docloom.plans.corpus import Corpus


class Builder:
    """What is selected so far: a relation inside the documents' arrays, or rows of it after a condition or an expression on columns."""

    def __init__(self, corpus: Corpus, now: Relation | None = None, made: DataFrame | None = None):
        self.corpus, self.now, self.made = corpus, now or Compiler(corpus).start(), made

    def _select(self, name: str, *args) -> Builder:
        if self.made is not None:
            raise QueryError(f"{name} can't follow a condition or an expression on columns")
        return Builder(self.corpus, Compiler(self.corpus).select(Selector(name, tuple(Literal(a) for a in args)), self.now))

    def headings(self, *levels: int) -> Builder:
        return self._select("headings", *levels)

    def section(self, title: str) -> Builder:
        return self._select("section", title)

    def sections(self) -> Builder:
        return self._select("sections")

    def code(self, *languages: str) -> Builder:
        return self._select("code", *languages)

    def links(self) -> Builder:
        return self._select("links")

    def images(self) -> Builder:
        return self._select("images")

    def tables(self) -> Builder:
        return self._select("tables")

    def lists(self, ordered: bool | None = None) -> Builder:
        return self._select("lists", *([] if ordered is None else [ordered]))

    def text(self) -> Builder:
        return self._select("text")

    def _gate(self, corpus: Corpus) -> Builder:
        if self.made is None:
            return Builder(corpus, replace(self.now, corpus=corpus))
        ids = corpus.parsed.select("doc_id").distinct()
        return Builder(corpus, replace(self.now, corpus=corpus), self.made.join(ids, "doc_id", "left_semi"))

    def _rows(self) -> DataFrame:
        return self.now.numbered() if self.made is None else self.made

    def where_owner(self, owner: str) -> Builder:
        """Goes on with the documents of that owner alone."""
        return self._gate(self.corpus.where_owner(owner))

    def where_tag(self, tag: str) -> Builder:
        return self._gate(self.corpus.where_tag(tag))

    def where_priority(self, priority: str) -> Builder:
        return self._gate(self.corpus.where_priority(priority))

    def filter(self, condition: Column | str) -> Builder:
        return Builder(self.corpus, self.now, self._rows().filter(condition))

    def map(self, expression: Column | str, type: str = "string") -> Builder:  # noqa: A002
        value = F.expr(expression) if isinstance(expression, str) else expression
        return Builder(self.corpus, replace(self.now, kind="values", type=type), self._rows().select("doc_id", "ord", value.alias("value")))

    def _ranked(self, condition: Column) -> Builder:
        rows = self._rows().withColumn("__k", F.row_number().over(W.partitionBy("doc_id").orderBy("ord")))
        return Builder(self.corpus, self.now, rows.filter(condition).drop("__k"))

    def take(self, n: int) -> Builder:
        """The first n rows of each document."""
        if self.made is None and self.now.kind != "document":
            return Builder(self.corpus, Compiler(self.corpus).between(self.now, 0, n))
        return self._ranked(F.col("__k") <= n)

    def skip(self, n: int) -> Builder:
        if self.made is None and self.now.kind != "document":
            return Builder(self.corpus, Compiler(self.corpus).between(self.now, n, None))
        return self._ranked(F.col("__k") > n)

    def count(self) -> DataFrame:
        """(doc_id, value): rows of each document, 0 where there are none."""
        if self.made is None and self.now.kind not in ("document", "values"):
            return Compiler(self.corpus).length(self.now).rows()
        none = self.corpus.parsed.select("doc_id", F.lit(0).alias("n"))
        return self._rows().select("doc_id", F.lit(1).alias("n")).union(none).groupBy("doc_id").agg(F.sum("n").alias("value"))

    def result(self) -> DataFrame:
        return self._rows().drop("ord")

    def _as(self, kind: str) -> DataFrame:
        if self.now.kind != kind:
            raise QueryError(f"these are {self.now.kind}, not {kind}")
        return self.result()

    def as_headings(self) -> DataFrame:
        return self._as("headings")

    def as_sections(self) -> DataFrame:
        return self._as("sections")

    def as_code(self) -> DataFrame:
        return self._as("code")

    def as_links(self) -> DataFrame:
        return self._as("links")
