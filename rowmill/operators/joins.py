"""Join chains and subquery joins. Spark chooses between broadcast, hash and sort-merge joins by the sizes it sees at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.names import unused
from rowmill.functions.predicates import OPERATORS, col, is_text

JOINT = "__"


def aliased(df: DataFrame, alias: str) -> DataFrame:
    """df with columns alias__column, so that self-joins and equal names stay apart."""
    return df.select(*(col(df, c).alias(f"{alias}{JOINT}{c}") for c in df.columns))


def resolve(df: DataFrame, name: str) -> str:
    """The chain's column for `alias.column`, or for `column` the first in the order of the chain that has it."""
    if "." in name:
        wanted = name.replace(".", JOINT, 1)
        if wanted in df.columns:
            return wanted
    else:
        for c in df.columns:
            if c.partition(JOINT)[2] == name:
                return c
    raise ValueError(f"unknown column {name!r}")


def chain(first: tuple[str, DataFrame], *joins: tuple[str, DataFrame, str, str, str]) -> DataFrame:
    """first is (alias, table); each join is (alias, table, `inner` or `left`, name, name), joined where the two names' columns are equal.

    Null keys match nothing. A condition between tables that were joined before pairs what passes it with all rows. A
    number never equals a text."""
    alias, table = first
    out = aliased(table, alias)
    for alias, table, how, a, b in joins:
        if how not in ("inner", "left"):
            raise ValueError(f"unknown join {how!r}")
        right = aliased(table, alias)
        whole = {c: df for df in (out, right) for c in df.columns}
        names = [next((c for c in whole if c == x.replace(".", JOINT, 1) or "." not in x and c.partition(JOINT)[2] == x), None) for x in (a, b)]
        if None in names:
            raise ValueError(f"unknown column in {a} = {b}")
        x, y = names
        alike = is_text(whole[x], x) == is_text(whole[y], y)
        out = out.join(right, whole[x][x] == whole[y][y] if alike else F.lit(False), how)
    return out


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Output columns of a chain: output name = `alias.column` or `column`."""
    return df.select(*(F.col(resolve(df, n)).alias(out) for out, n in names.items()))


def in_query(df: DataFrame, name: str, query: DataFrame) -> DataFrame:
    """Rows whose value the query's only column has."""
    key = _only(query)
    (member,) = unused(df.columns, "member")
    return df.join(query.select(key.alias(member)), col(df, name) == F.col(member), "left_semi")


def not_in_query(df: DataFrame, name: str, query: DataFrame) -> DataFrame:
    """Rows with a value that the query's only column lacks; its nulls are ignored, and rows without a value go."""
    key = _only(query)
    (member,) = unused(df.columns, "member")
    return df.filter(col(df, name).isNotNull()).join(query.select(key.alias(member)), col(df, name) == F.col(member), "left_anti")


def compare_query(df: DataFrame, name: str, op: str, query: DataFrame) -> DataFrame:
    """Rows for which name op the query's only value holds; none if it is empty, and an error if it has more than one row."""
    n = F.count(F.lit(1))
    value, single = unused(df.columns, "value", "single")
    one = query.select(_only(query).alias(value)).agg(F.first(value).alias(value), F.when(n > 1, F.raise_error(F.lit("a scalar query has several rows"))).otherwise(F.lit(True)).alias(single))
    if is_text(df, name) != is_text(one, value):
        return df.filter(F.lit(False))
    # one row by construction
    return df.join(F.broadcast(one), OPERATORS[op](col(df, name), F.col(value)) & F.col(single)).select(*(df[c] for c in df.columns))


def unmatched(df: DataFrame, name: str, other: DataFrame, key: str) -> DataFrame:
    """Rows that an outer join would give no partner."""
    (member,) = unused(df.columns, "member")
    return df.join(other.select(col(other, key).alias(member)), col(df, name) == F.col(member), "left_anti")


def _only(query: DataFrame):
    if len(query.columns) != 1:
        raise ValueError("a subquery has one column")
    return col(query, query.columns[0])
