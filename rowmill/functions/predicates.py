"""Row predicates. All are built-in column expressions, so filters reach the Parquet scan and stay in generated code.

A predicate that a null makes unknown keeps no row. Comparisons of a number with a text never hold, in either
direction. LIKE has no escape character. Lists and subqueries of NOT IN ignore their nulls.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = {"=": eq, "!=": ne, "<>": ne, "<": lt, "<=": le, ">": gt, ">=": ge}


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(field(df, name).dataType, (T.StringType, T.CharType, T.VarcharType))


def field(df: DataFrame, name: str) -> T.StructField:
    """The column of this exact name; ValueError if there is none."""
    for f in df.schema.fields:
        if f.name == name:
            return f
    raise ValueError(f"unknown column {name!r}")


def col(df: DataFrame, name: str) -> Column:
    return df[f"`{field(df, name).name}`"]


def compare(df: DataFrame, name: str, op: str, value: int | float | str | None) -> Column:
    """name op value; false for a null value and where one side is a text and the other a number."""
    column = col(df, name)
    if value is None or isinstance(value, str) != is_text(df, name):
        return F.lit(False)
    return OPERATORS[op](column, F.lit(value))


def between(df: DataFrame, name: str, low: int | str, high: int | str) -> Column:
    return compare(df, name, ">=", low) & compare(df, name, "<=", high)


def is_null(df: DataFrame, name: str) -> Column:
    return col(df, name).isNull()


def is_not_null(df: DataFrame, name: str) -> Column:
    return col(df, name).isNotNull()


def like(df: DataFrame, name: str, pattern: str) -> Column:
    """% stands for any characters and _ for one; all others, backslashes too, for themselves."""
    return col(df, name).like(pattern.replace("\\", "\\\\")) if is_text(df, name) else F.lit(False)


def not_like(df: DataFrame, name: str, pattern: str) -> Column:
    return ~col(df, name).like(pattern.replace("\\", "\\\\")) if is_text(df, name) else F.lit(False)


def _members(df: DataFrame, name: str, values: Iterable) -> list:
    return [v for v in values if v is not None and isinstance(v, str) == is_text(df, name)]


def in_values(df: DataFrame, name: str, values: Iterable) -> Column:
    return col(df, name).isin(_members(df, name, values))


def not_in_values(df: DataFrame, name: str, values: Iterable) -> Column:
    """Not null and unlike every value that is not null."""
    return col(df, name).isNotNull() & ~col(df, name).isin(_members(df, name, values))


def any_of(*groups: Iterable[Column]) -> Column:
    """Rows that pass all predicates of one group at least."""
    return reduce(or_, (reduce(and_, g) for g in groups))
