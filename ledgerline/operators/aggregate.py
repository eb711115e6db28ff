"""Grouped and global aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import number
from ..plans.conditions import quoted, resolve

FUNCTIONS = ("count", "sum", "min", "max", "avg", "distinct")


def expression(df: DataFrame, func: str, column: str | None, nulls: str = "zero") -> Column:
    """An aggregate over df's rows: unreadable numbers count as 0 or, with nulls="skip", not at all."""
    if func == "count":
        return F.count(F.lit(1))
    if func == "distinct":
        return F.count_distinct(quoted(resolve(df, column))) if column else F.lit(1.0)
    if func not in FUNCTIONS:
        raise ValueError(f"unknown aggregate: {func}")
    if column is None:
        raise ValueError(f"{func} takes a column")
    name = resolve(df, column)
    value = number(quoted(name), dict(df.dtypes)[name], nulls)
    return {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[func](value)


def grouped(df: DataFrame, keys: list[str], func: str, column: str | None = None, alias: str = "value", nulls: str = "zero") -> DataFrame:
    """A row per group: the keys and the value. "distinct" without a column lists the groups, each with 1. Partial sums meet after one shuffle."""
    names = [resolve(df, k) for k in keys]
    if func in ("", "distinct") and not column:
        return df.select(*map(quoted, names)).distinct().withColumn(alias, F.lit(1.0))
    return df.groupBy(*map(quoted, names)).agg(expression(df, func, column, nulls).alias(alias))
