"""A corpus: parsed documents in one nested table, its element tables derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.sources.structure import ELEMENTS

INFO = ("doc_id", "path", "format", "title", "readable_text", "line_count", "metadata", "parse_error")


class Corpus:
    """Documents (doc_id, path, format, title, source, readable_text, line_count, metadata, parse_error) and their elements.

    Element tables are generated from arrays of the nested table: no shuffle,
    and Catalyst reads no other array.  Conditions on an element that are
    known early are applied inside the array, before its rows are made.
    """

    def __init__(self, parsed: DataFrame, want: list[str]):
        self.parsed, self.want = parsed, want

    def cache(self) -> Corpus:
        """The same, kept by the executors once it has been parsed."""
        return Corpus(self.parsed.cache(), self.want)

    @property
    def documents(self) -> DataFrame:
        first = F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))["text"] if "headings" in self.want else F.lit(None)
        title = F.coalesce(F.when(F.col("title") != "", F.col("title")), first, F.lit(""))
        return self.parsed.select(*(c for c in INFO if c != "title"), title.alias("title"), "source")

    def where(self, condition: Column) -> Corpus:
        """Only documents that meet a condition on the document."""
        return Corpus(self.parsed.filter(condition), self.want)

    def elements(self, name: str, early=None) -> DataFrame:
        """(doc_id, columns of the element); early: a condition on an element, as a function of its struct."""
        if name not in self.want:
            raise ValueError(f"{name} were not asked for when the corpus was read")
        array = F.col(name) if early is None else F.filter(name, early)
        return self.parsed.select("doc_id", F.explode(array).alias("e")).select("doc_id", *(F.col(f"e.{c}") for c in ELEMENTS[name].names))

    @property
    def headings(self) -> DataFrame:
        return self.elements("headings")

    @property
    def code_blocks(self) -> DataFrame:
        return self.elements("code_blocks")

    @property
    def links(self) -> DataFrame:
        return self.elements("links")

    @property
    def images(self) -> DataFrame:
        return self.elements("images")

    @property
    def tables(self) -> DataFrame:
        return self.elements("tables")

    @property
    def lists(self) -> DataFrame:
        return self.elements("lists")

    @property
    def list_items(self) -> DataFrame:
        return self.elements("list_items")

    def sections(self, early=None, text: bool = True) -> DataFrame:
        """All sections; text is what stands between their lines, their children's included, and nothing for formats without lines."""
        if "sections" not in self.want:
            raise ValueError("sections were not asked for when the corpus was read")
        array = F.col("sections") if early is None else F.filter("sections", early)
        names = ELEMENTS["sections"].names
        if text:
            from docloom.operators.structure import section_text, with_lines

            array = with_lines(lambda ls: F.transform(array, lambda s: F.struct(*(s[c].alias(c) for c in names), section_text(s, ls).alias("text"))))
        return self.parsed.select("doc_id", F.explode(array).alias("e")).select("doc_id", "e.*")

    def metadata(self, field: str) -> Column:
        """A string of the front matter, null if it is missing or no string."""
        v = F.try_variant_get(F.try_parse_json("metadata"), f"$.{field}", "variant")
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    def tags(self) -> Column:
        """The strings among the tags of the front matter; null without tags."""
        items = F.try_variant_get(F.try_parse_json("metadata"), "$.tags", "array<variant>")
        return F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))

    def where_owner(self, owner: str) -> Corpus:
        return self.where(self.metadata("owner") == owner)

    def where_priority(self, priority: str) -> Corpus:
        return self.where(self.metadata("priority") == priority)

    def where_tag(self, tag: str) -> Corpus:
        return self.where(F.coalesce(F.array_contains(self.tags(), tag), F.lit(False)))
