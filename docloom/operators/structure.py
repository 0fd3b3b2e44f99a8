"""Operators on the structure of documents: hierarchy, search, outlines, directories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.plans.corpus import Corpus

MODES = ("", "compact", "preview", "full")


def hierarchy(headings: DataFrame, line_count: Column | None = None) -> DataFrame:
    """Sections of a table of headings (doc_id, pos, level, text, line), whatever made it: parent_pos, end_line, indexed.

    The parent is the last earlier heading of a lower level; a section ends
    before the next heading of its level or a lower one, or with the document.
    """
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("doc_id").orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    out, level = headings, F.col("level")
    for k in range(1, 7):
        out = out.withColumn(f"p{k}", F.max(F.when(level == k, F.col("pos"))).over(before)).withColumn(f"n{k}", F.min(F.when(level == k, F.col("line"))).over(after))
    none = F.lit(None).cast("int")
    parent = F.greatest(*(F.when(level > k, F.col(f"p{k}")) for k in range(1, 7)), none)
    end = F.least(*(F.when(level >= k, F.col(f"n{k}")) for k in range(1, 7)), none) - 1
    out = out.withColumn("parent_pos", parent).withColumn("end_line", F.coalesce(end, line_count) if line_count is not None else end)
    last = F.row_number().over(W.partitionBy("doc_id", "text").orderBy(F.desc("pos"))) == 1
    return out.withColumn("indexed", last).drop(*(f"{a}{k}" for a in "pn" for k in range(1, 7)))


def section_text(section: Column, lines: Column) -> Column:
    """What stands between a section's lines; lines: those of the document."""
    n = F.greatest(section["end_line"] - section["start_line"] + 1, F.lit(0))
    return F.when((section["start_line"] > 0) & (n > 0), F.array_join(F.slice(lines, section["start_line"], n), "\n")).otherwise("")


def with_lines(make: Callable[[Column], Column]) -> Column:
    """make of the document's lines, which are split off its source once however often make uses them."""
    return F.get(F.transform(F.array(F.split("source", "\n")), make), F.lit(0))


def below(section: Column, sections: Column | str = "sections") -> Column:
    """The section and all below it, as a part of the array of sections."""
    return F.slice(sections, section["section_id"] + 1, section["last"] - section["section_id"] + 1)


def children_of(section: Column) -> Column:
    return F.filter(below(section), lambda c: c["parent_id"] == section["section_id"])


def code_of(section: Column) -> Column:
    """Code blocks of a section and of those below it."""
    return F.slice("code_blocks", section["code_from"] + 1, section["code_to"] - section["code_from"])


def children(corpus: Corpus, sections: DataFrame) -> DataFrame:
    """The children of some sections, with the columns of sections."""
    own = sections.select("doc_id", F.col("section_id").alias("__parent")).distinct()
    return corpus.sections().join(own, "doc_id").filter(F.col("parent_id") == F.col("__parent")).drop("__parent")


def section_code(corpus: Corpus, chosen: Callable[[Column], Column]) -> DataFrame:
    """Code blocks of the sections that meet a condition and of the sections below them, each once; made inside the arrays of each document."""
    blocks = F.flatten(F.transform(F.filter("sections", chosen), code_of))
    return corpus.parsed.select("doc_id", F.explode(F.array_distinct(blocks)).alias("e")).select("doc_id", "e.*")


def found(term: str, lines: Column) -> Column:
    """Of each section whose text holds the term, whatever the case: pos, section, level, lines, match."""
    texts = F.transform(F.filter("sections", lambda s: s["indexed"]), lambda s: F.struct(s.alias("s"), section_text(s, lines).alias("t")))
    hits = F.filter(texts, lambda x: F.contains(F.lower(x["t"]), F.lit(term.lower())))

    def hit(x: Column) -> Column:
        span = F.concat_ws("-", x["s"]["start_line"].cast("string"), x["s"]["end_line"].cast("string"))
        return F.struct(x["s"]["pos"].alias("pos"), x["s"]["title"].alias("section"), x["s"]["level"].alias("level"), span.alias("lines"), X.snippet(x["t"], term).alias("match"))

    return F.transform(hits, hit)


def search(corpus: Corpus, term: str) -> DataFrame:
    """(doc_id, pos, section, level, lines, match): sections whose text holds the term, whatever the case."""
    return corpus.parsed.select("doc_id", F.explode(with_lines(lambda ls: found(term, ls))).alias("e")).select("doc_id", "e.*")


def outline(mode: str, lines: Column, scope: Column | None = None) -> Column:
    """Rows of a document's outline, in order: depth, type, text, preview, start_line, end_line, level, meta.

    Sections in order; "" adds the code blocks of each by language, "preview"
    and "full" the first line of prose, "compact" nothing.  A top section that
    a later one of the same title hides is left out with all below it.  With a
    scope, an array of sections, only these and what is below them, where
    blocks count with those of the sections below.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode!r}")
    none = F.lit(None).cast("int")

    def row(depth: Column, kind: str, text: Column, preview: Column, start: Column, end: Column, level: Column, meta: Column) -> Column:
        values = {"depth": depth.cast("int"), "type": F.lit(kind), "text": text, "preview": preview, "start_line": start, "end_line": end, "level": level, "meta": meta}
        return F.struct(*(v.alias(k) for k, v in values.items()))

    def rows(s: Column, depth: Column) -> Column:
        preview = X.preview(section_text(s, lines)) if mode in ("preview", "full") else F.lit("")
        own = F.array(row(depth, "section", s["title"], preview, s["start_line"], s["end_line"], s["level"], F.lit("")))
        if mode:
            return own
        blocks = code_of(s) if scope is not None else F.filter(code_of(s), lambda b: b["section_id"] == s["section_id"])
        named = F.transform(blocks, lambda b: F.coalesce(F.nullif(b["language"], F.lit("")), F.lit("plain")))

        def code(name: Column) -> Column:
            n = F.size(F.filter(named, lambda x: x == name))
            return row(depth + 1, "code", name, F.lit(""), none, none, none, F.concat(n.cast("string"), F.when(n > 1, " blocks").otherwise(" block")))

        return F.concat(own, F.transform(F.array_sort(F.array_distinct(named)), code))

    if scope is None:
        tops = F.transform(F.filter("sections", lambda s: s["indexed"] & s["parent_id"].isNull()), lambda s: s["section_id"])
        shown = F.filter("sections", lambda s: F.array_contains(tops, F.get(s["path"], F.lit(0))))
        return F.flatten(F.transform(shown, lambda s: rows(s, F.size(s["path"]) - 1)))
    return F.flatten(F.transform(scope, lambda t: F.flatten(F.transform(below(t), lambda s: rows(s, F.size(s["path"]) - F.size(t["path"]))))))


def tree(corpus: Corpus, mode: str = "") -> DataFrame:
    """(doc_id, seq, depth, type, text, preview, start_line, end_line, level, meta): each document's outline."""
    return corpus.parsed.select("doc_id", F.posexplode(with_lines(lambda ls: outline(mode, ls))).alias("seq", "e")).select("doc_id", "seq", "e.*")


def files(corpus: Corpus, mode: str = "") -> DataFrame:
    """(path, lines, sections, headings, previews, parse_error): each file's size and, for "preview" and "full", its top headings and their children of level 1 or 2; for "full" the first line of prose of each too."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode!r}")
    indexed = F.filter("sections", lambda s: s["indexed"])
    none = F.array().cast("array<string>")
    ids = F.transform(F.filter("sections", lambda s: s["indexed"] & s["parent_id"].isNull()), lambda s: s["section_id"])
    shown = F.filter("sections", lambda s: F.array_contains(ids, s["section_id"]) | (F.coalesce(F.array_contains(ids, s["parent_id"]), F.lit(False)) & (s["level"] <= 2)))
    headings = F.transform(shown, lambda s: F.concat(F.repeat(F.lit("#"), s["level"]), F.lit(" "), s["title"])) if mode in ("preview", "full") else none
    previews = with_lines(lambda ls: F.transform(shown, lambda s: X.preview(section_text(s, ls)))) if mode == "full" else none
    return corpus.parsed.select("path", F.col("line_count").alias("lines"), F.size(indexed).alias("n"), headings.alias("h"), previews.alias("previews"), "parse_error").withColumnsRenamed({"n": "sections", "h": "headings"})


def directories(corpus: Corpus, root: str = "") -> DataFrame:
    """(directory, files, lines, sections): totals of every directory with all below it; root, a prefix of the paths, is the first."""
    rel = F.regexp_replace(F.substring(F.col("path"), len(root) + 1, 1_000_000), "^/+", "")
    parts = F.slice(F.split(rel, "/"), 1, F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0)))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = corpus.parsed.select(F.explode(prefixes).alias("directory"), F.col("line_count").alias("lines"), F.size(F.filter("sections", lambda s: s["indexed"])).alias("sections"))
    return rows.groupBy("directory").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("sections").alias("sections"))


def summary(corpus: Corpus) -> DataFrame:
    """One row for each document: title, lines, numbers of elements, languages and table of contents."""
    n = {c: F.size(c).alias(f"n_{c}") for c in ("headings", "code_blocks", "links", "images", "tables", "lists")}
    languages = F.array_sort(F.array_distinct(F.filter(F.transform("code_blocks", lambda c: c["language"]), lambda x: x != "")))
    toc = F.transform(F.filter("sections", lambda s: s["indexed"] & s["parent_id"].isNull()), lambda s: s["title"])
    return corpus.parsed.select("doc_id", "path", "format", "title", "line_count", "metadata", F.size(F.filter("sections", lambda s: s["indexed"])).alias("n_sections"), *n.values(), languages.alias("languages"), toc.alias("contents"))


def details(corpus: Corpus) -> DataFrame:
    """One row for each document with all that a summary of it shows."""
    return corpus.parsed.select("doc_id", "path", "format", "title", "readable_text", "metadata", corpus.metadata("owner").alias("owner"), corpus.tags().alias("tags"), corpus.metadata("priority").alias("priority"), "headings", "sections", "code_blocks", "tables", "links", "images")
