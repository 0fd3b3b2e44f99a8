"""PDF: headings inferred from font sizes, of one file while it is parsed or as DataFrame operators over a table of text lines.

The lines of a file come from pdf_text; a table of lines (doc_id, seq, page,
text, size, bold) may come from any extractor.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.sources import pdf_text
from docloom.sources.structure import Structure

DEFAULT_SIZE = 12.0
MIN_RATIO = 1.15
#: Openings of notices and addresses rather than headings.
NOT_HEADINGS = ("arxiv:", "copyright ", "doi:", "http://", "https://", "permission ", "provided ", "reproduce ")


def body_sizes(lines: DataFrame) -> DataFrame:
    """(doc_id, body_size): the most frequent size, to a tenth; of equals the smallest; 12 where no line has one."""
    counts = lines.groupBy("doc_id", F.round("size", 1).alias("s")).agg(F.count("size").alias("n"))
    best = counts.groupBy("doc_id").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("b"))
    return best.select("doc_id", F.coalesce("b", F.lit(DEFAULT_SIZE)).alias("body_size"))


def likely_heading(text: Column) -> Column:
    """Whether a line reads like a heading."""
    t = F.trim(text)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    opening = F.lower(t)
    bad = F.lit(False)
    for p in NOT_HEADINGS:
        bad = bad | opening.startswith(p)
    return F.length(t).between(2, 150) & ~F.regexp_replace(t, r".$", "").contains(". ") & (letters * 2 >= F.length(t)) & ~bad & ~t.endswith("*") & ~t.endswith("∗")


def heading_level(ratio: Column, bold: Column, min_ratio: float = MIN_RATIO) -> Column:
    """1 to 4 by the ratio to the body's size, less of it for bold lines; null for no heading."""
    b = F.coalesce(bold, F.lit(False))
    return F.when((ratio >= 2.0) | (b & (ratio >= 1.5)), 1).when((ratio >= 1.5) | (b & (ratio >= 1.3)), 2).when((ratio >= 1.25) | (b & (ratio >= 1.15)), 3).when((ratio >= min_ratio) | b, 4)


def infer_headings(lines: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(doc_id, pos, level, text, page): of lines with the same text only the first is a heading."""
    sized = lines.join(body_sizes(lines).withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d"))).drop("d")
    level = heading_level(F.col("size") / F.col("body_size"), F.col("bold"), min_ratio)
    some = sized.withColumn("level", level).withColumn("text", F.trim("text")).filter(F.col("level").isNotNull() & likely_heading(F.col("text")))
    first = some.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "text").orderBy("seq"))).filter("k = 1")
    return first.withColumn("pos", F.row_number().over(W.partitionBy("doc_id").orderBy("seq")) - 1).select("doc_id", "pos", "level", "text", "page")


def titles(headings: DataFrame) -> DataFrame:
    """(doc_id, title): the first heading of level 1 or 2 on the first page."""
    return headings.filter("page = 1 AND level <= 2").groupBy("doc_id").agg(F.min_by("text", "pos").alias("title"))


def is_heading(text: str) -> bool:
    """The same as likely_heading, of one text that has no white space around."""
    letters = sum(c.isalpha() for c in text)
    return 2 <= len(text) <= 150 and ". " not in text[:-1] and 2 * letters >= len(text) and not text.lower().startswith(NOT_HEADINGS) and not text.endswith(("*", "∗"))


def level_of(ratio: float, bold: bool, min_ratio: float = MIN_RATIO) -> int | None:
    """The same as heading_level, of one line."""
    for level, (plain, heavy) in enumerate([(2.0, 1.5), (1.5, 1.3), (1.25, 1.15)], 1):
        if ratio >= plain or bold and ratio >= heavy:
            return level
    return 4 if ratio >= min_ratio or bold else None


def parse(content: bytes, infer: bool = True, detect_tables: bool = True, min_ratio: float = MIN_RATIO) -> Structure:
    """The structure of a PDF: its text, headings told by size and weight, the sections they begin, the headers of its tables, and the first large heading of page 1 as its title.

    infer and detect_tables switch headings and tables off; min_ratio is the
    least ratio to the body's size of a heading that isn't bold.  What is no
    PDF is an empty document.
    """
    found = pdf_text.lines(content)
    out = Structure(readable_text="\n".join("    ".join(t for _, t in x.cells) for x in found), line_count=len(found))
    counts = Counter(round(x.size, 1) for x in found)
    body = min((-n, s) for s, n in counts.items())[1] if counts else DEFAULT_SIZE
    seen: set[str] = set()
    for x in found if infer else ():
        level = level_of(x.size / body if body > 0 else 1.0, x.bold, min_ratio)
        if level and x.text not in seen and is_heading(x.text):
            seen.add(x.text)
            out.add_heading(level, x.text)
            if not out.title and x.page == 1 and level <= 2:
                out.title = x.text
    for t in pdf_text.tables(found) if detect_tables else ():
        out.add_table(t[0], [])
    out.sections_from_headings(with_lines=False)
    return out
