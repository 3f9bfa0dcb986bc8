"""Projection, ordering, limits, distinct rows and aggregates over one DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.names import unused
from rowmill.functions.predicates import OPERATORS, col, is_text

FUNCTIONS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def project(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(col(df, n) for n in names))


def sort_key(df: DataFrame, key: str | int) -> Column:
    """A column's name or its position from 1; with a minus, descending. Nulls are larger than all values."""
    down = key < 0 if isinstance(key, int) else key.startswith("-")
    name = key.removeprefix("-") if isinstance(key, str) else key
    if isinstance(name, int):
        if not 1 <= abs(name) <= len(df.columns):
            raise ValueError(f"no output column {abs(name)}")
        name = df.columns[abs(name) - 1]
    return col(df, name).desc_nulls_first() if down else col(df, name).asc_nulls_last()


def ordered(df: DataFrame, *keys: str | int, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sorted rows, cut. With a limit Spark keeps only each task's first offset + limit rows."""
    if keys:
        df = df.orderBy(*(sort_key(df, k) for k in keys))
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def distinct(df: DataFrame, *names: str) -> DataFrame:
    """Distinct rows of the named columns, all if none; nulls equal each other."""
    return (project(df, *names) if names else df).distinct()


def aggregate_item(df: DataFrame, function: str, name: str | None = None) -> Column:
    """count of rows or of values that are not null; sum and avg of numbers; min and max of numbers or texts by their bytes."""
    if function not in FUNCTIONS:
        raise ValueError(f"unknown aggregate {function!r}")
    if name is None:
        if function != "count":
            raise ValueError(f"{function} needs a column")
        return F.count(F.lit(1))
    if function in ("sum", "avg") and is_text(df, name):
        raise ValueError(f"{function} of a text")
    return FUNCTIONS[function](col(df, name))


def aggregate(df: DataFrame, items: dict[str, tuple], by: str | None = None, having: tuple | None = None) -> DataFrame:
    """A row for each group, or one for all rows.

    items: names of the output columns; each is (function, column), (function,) or, for the value of any row, ("first", column), or
    ("key",). having: (function, column or None, operator, value), which need not be among the items; groups whose
    aggregate is null are dropped. Null keys are one group."""
    if having and by is None:
        raise ValueError("having needs groups")
    if by is None and any(i[0] == "key" for i in items.values()):
        raise ValueError("there is no key without groups")
    having_name, key_name, none_name = unused([*df.columns, *items], "having", "key", "none")
    made = {n: F.first(col(df, i[1]), ignorenulls=False) if i[0] == "first" else aggregate_item(df, *i) for n, i in items.items() if i[0] != "key"}
    columns = [c.alias(n) for n, c in made.items()]
    if having:
        function, name, op, value = having
        if name is not None and function in ("min", "max") and isinstance(value, str) != is_text(df, name):
            raise ValueError("having compares a number with a text")
        columns.append(aggregate_item(df, function, name).alias(having_name))
    if by is None:
        return df.agg(*columns).select(*items)
    out = df.groupBy(col(df, by).alias(key_name)).agg(*(columns or [F.lit(1).alias(none_name)]))
    if having:
        out = out.filter(OPERATORS[op](F.col(having_name), F.lit(value)))
    return out.select(*(F.col(key_name).alias(n) if i[0] == "key" else F.col(n) for n, i in items.items()))
