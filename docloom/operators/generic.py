"""Operators over any DataFrame: filter, map, flat map, reduce, take, skip, unique, group, sort, find, any, all.

Order is explicit: what depends on it takes the columns that order the rows.
Conditions and transforms are column expressions; where there is none, `python`
makes one of a Python function over whole columns, by Arrow.
"""

from __future__ import annotations

from builtins import any as any_
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Expression = Column | str


def _c(x: Expression) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def python(function: Callable[..., pd.Series], returns: str, *columns: Expression) -> Column:
    """A Python function of pandas Series, one for each of the columns, as an expression of the type named."""

    def run(*series: pd.Series) -> pd.Series:
        return function(*series)

    return F.pandas_udf(run, returns)(*map_(columns))


def filter(df: DataFrame, condition: Expression) -> DataFrame:  # noqa: A001
    return df.filter(condition)


def map(df: DataFrame, **columns: Expression) -> DataFrame:  # noqa: A001
    """The named expressions of each row."""
    return df.select(*(_c(v).alias(k) for k, v in columns.items()))


def flat_map(df: DataFrame, array: Expression, name: str, *keep: str) -> DataFrame:
    """A row for each item of an array expression."""
    return df.select(*keep, F.explode(_c(array)).alias(name))


def reduce(df: DataFrame, value: Expression, initial: Column, step: Callable[[Column, Column], Column], order: list[Expression], by: list[str] | None = None) -> DataFrame:
    """Folds a value over the rows in order, of each group if there are keys: (keys, result).

    For sums, extremes and the like an aggregate of its own is better: this
    one brings the values of a group together.
    """
    keys = list(by or [])
    rows = F.array_sort(F.collect_list(F.struct(*(_c(o).alias(f"o{k}") for k, o in enumerate(order)), _c(value).alias("v"))))
    held = df.groupBy(*keys).agg(rows.alias("rows")) if keys else df.agg(rows.alias("rows"))
    return held.select(*keys, F.aggregate(F.transform("rows", lambda r: r["v"]), initial, step).alias("result"))


def take(df: DataFrame, n: int, *order: Expression) -> DataFrame:
    """The first n rows; none for n below 1."""
    return df.orderBy(*map_(order)).limit(max(n, 0))


def skip(df: DataFrame, n: int, *order: Expression) -> DataFrame:
    """All but the first n rows; all for n below 1.

    Only those first n come together in one place; the others are what is left
    without them, as often as each row is there.  Columns that can't be
    compared (maps, variants) take an offset, which brings all rows together.
    """
    by = map_(order)
    if n < 1:
        return df.orderBy(*by)
    if any_(("map<" in kind or "variant" in kind) for _, kind in df.dtypes):
        return df.orderBy(*by).offset(n)
    return df.exceptAll(df.orderBy(*by).limit(n)).orderBy(*by)


def map_(order: tuple[Expression, ...]) -> list[Column]:
    return [_c(o) for o in order]


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values."""
    return (df.select(*columns) if columns else df).distinct()


def unique_by(df: DataFrame, keys: list[str], *order: Expression) -> DataFrame:
    """The first row of each key."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*map_(order)))
    return df.withColumn("__k", first).filter("__k = 1").drop("__k")


def group_by(df: DataFrame, keys: list[str], *order: Expression, **items: Expression) -> DataFrame:
    """(keys, items): the named expressions of each group's rows as structs, in order."""
    row = F.struct(*(_c(o).alias(f"__o{k}") for k, o in enumerate(order)), *(_c(v).alias(k) for k, v in items.items()))
    held = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("items"))
    return held.withColumn("items", F.transform("items", lambda r: F.struct(*(r[k].alias(k) for k in items))))


def sort_by(df: DataFrame, *order: Expression) -> DataFrame:
    return df.orderBy(*map_(order))


def find(df: DataFrame, condition: Expression, *order: Expression) -> DataFrame:
    """The first row that meets a condition, or none."""
    return df.filter(condition).orderBy(*map_(order)).limit(1)


def any(df: DataFrame, condition: Expression) -> DataFrame:  # noqa: A001
    """(result): whether some row meets a condition; false without rows."""
    return df.agg(F.coalesce(F.bool_or(_c(condition)), F.lit(False)).alias("result"))


def all(df: DataFrame, condition: Expression) -> DataFrame:  # noqa: A001
    """(result): whether every row meets a condition; true without rows."""
    return df.agg(F.coalesce(F.bool_and(F.coalesce(_c(condition), F.lit(False))), F.lit(True)).alias("result"))


class Chain:
    """Operators one after another, over rows in a given order."""

    def __init__(self, df: DataFrame, *order: Expression):
        self.df, self.order = df, order

    def filter(self, condition: Expression) -> Chain:
        return Chain(self.df.filter(condition), *self.order)

    def take(self, n: int) -> Chain:
        return Chain(take(self.df, n, *self.order), *self.order)

    def skip(self, n: int) -> Chain:
        return Chain(skip(self.df, n, *self.order), *self.order)

    def sort_by(self, *order: Expression) -> Chain:
        return Chain(self.df, *order)

    def map(self, **columns: Expression) -> DataFrame:
        return map(self.result(), **columns)

    def result(self) -> DataFrame:
        return self.df.orderBy(*map_(self.order))

    def count(self) -> int:
        return self.df.count()

    def first(self) -> DataFrame:
        return take(self.df, 1, *self.order)
