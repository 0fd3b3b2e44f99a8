"""Conditions on headings, code blocks and documents, as column expressions, and what uses them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_level(*levels: int) -> Column:
    """Any level if none is named."""
    return F.col("level").isin(*levels) if levels else F.lit(True)


def by_text_contains(part: str) -> Column:
    """Whatever the case."""
    return F.contains(F.lower("text"), F.lit(part.lower()))


def by_text_prefix(part: str) -> Column:
    return F.startswith("text", F.lit(part))


def combine(*conditions: Column) -> Column:
    """All of them; true for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def by_language(*languages: str) -> Column:
    """Whatever the case; any if none is named."""
    return F.lower("language").isin(*(x.lower() for x in languages)) if languages else F.lit(True)


def by_lines(least: int) -> Column:
    return F.col("lines") >= least


def headings_by_level(headings: DataFrame, *levels: int) -> DataFrame:
    return headings.filter(by_level(*levels))


def headings_by_text(headings: DataFrame, part: str) -> DataFrame:
    return headings.filter(by_text_contains(part))


def code_by_language(blocks: DataFrame, *languages: str) -> DataFrame:
    return blocks.filter(by_language(*languages))


def code_by_lines(blocks: DataFrame, least: int) -> DataFrame:
    return blocks.filter(by_lines(least))


def heading_texts(headings: DataFrame) -> DataFrame:
    return headings.select("doc_id", "pos", "text")


def section_texts(sections: DataFrame) -> DataFrame:
    return sections.select("doc_id", "pos", "text")


def code_contents(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "pos", "content")
