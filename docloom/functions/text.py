"""Text functions as column expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET, PREVIEW = 60, 50


def clean(text: Column) -> Column:
    """Blanks and tabs as one blank, at most one empty line, lines and text without white space around."""
    s = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    lines = F.transform(F.split(s, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Number of lines."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, which count from 1; nothing if start is 0 or after end."""
    n = F.greatest(end - start + 1, F.lit(0))
    return F.when((start > 0) & (n > 0), F.array_join(F.slice(F.split(text, "\n"), start, n), "\n")).otherwise("")


def snippet(text: Column, term: str, around: int = SNIPPET) -> Column:
    """The first occurrence of term, whatever the case, with so many characters on either side, white space as blanks; dots where it was cut."""
    at = F.locate(term.lower(), F.lower(text))
    size = F.length(F.lit(term))
    begin = F.greatest(at - around, F.lit(1))
    end = F.least(at + size + around - 1, F.length(text))
    body = F.regexp_replace(F.regexp_replace(F.substring(text, begin, end - begin + 1), r"\s+", " "), r"^ | $", "")
    out = F.concat(F.when(begin > 1, "...").otherwise(""), body, F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at > 0, out).otherwise("")


def preview(text: Column, most: int = PREVIEW) -> Column:
    """The first line of prose after the heading's line, without emphasis, cut at a blank where it is long."""
    rest = F.slice(F.split(text, "\n"), 2, 1_000_000_000)
    trimmed = F.transform(rest, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))

    def prose(x: Column) -> Column:
        return (F.length(x) > 0) & ~x.startswith("```") & ~x.startswith("---") & ~x.startswith("![") & ~(x.startswith("[") & x.contains("]("))

    line = F.coalesce(F.try_element_at(F.filter(trimmed, prose), F.lit(1)), F.lit(""))
    line = F.regexp_replace(line, r"\*\*|__|`", "")
    head = F.substring(line, 1, most)
    blank = F.length(head) - F.length(F.regexp_extract(head, r"[^ ]*$", 0)) - 1
    short = F.concat(F.when(blank > most // 2, F.substring(head, F.lit(1), blank)).otherwise(head), F.lit("..."))
    return F.when(F.length(line) > most, short).otherwise(line)
