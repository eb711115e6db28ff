"""Conditions, as JSON trees, maps or lists, compiled to one Column that Catalyst can push down."""

from __future__ import annotations

import json
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_empty, literal, number

LEAVES = ("=", "!=", ">", "<", ">=", "<=", "LIKE", "IN", "IS NULL", "IS NOT NULL")


def resolve(df: DataFrame, name: object) -> str:
    """The column of df that a name means, whatever its case; of equal names the last."""
    found = [c for c in df.columns if c.lower() == str(name).strip().lower()]
    if not found:
        raise ValueError(f"unknown column: {name}")
    return found[-1]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def parse(where: object) -> object:
    """A condition as a tree {operator, children} or {operator, column, value}; None for no condition.

    A map without "operator" is an AND of equalities. A list is [op, column, value], or ["AND" or "OR", condition, ...].
    """
    if isinstance(where, str):
        where = json.loads(where) if where.strip() else None
    if where is None or isinstance(where, Column) or where in ({}, []):
        return where if isinstance(where, Column) else None
    if isinstance(where, dict):
        if "operator" not in where:
            return {"operator": "AND", "children": [{"operator": "=", "column": k, "value": v} for k, v in where.items()]}
        op = where["operator"]
        if op in ("AND", "OR"):
            return {"operator": op, "children": [c for c in map(parse, where.get("children") or []) if c is not None]}
        return where
    if isinstance(where, (list, tuple)):
        op = str(where[0]).upper()
        if op in ("AND", "OR"):
            return {"operator": op, "children": [c for c in map(parse, where[1:]) if c is not None]}
        if len(where) < 2:
            raise ValueError("invalid where format")
        return {"operator": op, "column": where[1], "value": where[2] if len(where) > 2 else ""}
    raise ValueError("invalid where format")


def compile_condition(df: DataFrame, where: object, compare: str = "text") -> Column | None:
    """The condition on df, never null. compare="numeric" compares with > < >= <= and equality as numbers where the value is one."""
    tree = parse(where)
    return None if tree is None else _node(df, tree, compare)


def _node(df: DataFrame, node: object, compare: str) -> Column:
    if isinstance(node, Column):
        return F.coalesce(node, F.lit(False))
    op = node["operator"]
    if op in ("AND", "OR"):
        parts = [_node(df, c, compare) for c in node["children"]]
        return reduce(and_, parts, F.lit(True)) if op == "AND" else reduce(or_, parts, F.lit(False))
    if op not in LEAVES:
        raise ValueError(f"unknown operator: {op}")
    name = resolve(df, node.get("column"))
    cell, dtype = quoted(name), dict(df.dtypes)[name]
    if op == "IS NULL":
        return is_empty(cell)
    if op == "IS NOT NULL":
        return ~is_empty(cell)
    value = node.get("value", "")
    if op == "IN":
        if not isinstance(value, (list, tuple)):
            raise ValueError("IN takes a list")
        return F.coalesce(_text(cell, dtype).isin([literal(v) for v in value]), F.lit(False)) if value else F.lit(False)
    if value is None:
        if op in ("=", "!="):
            return is_empty(cell) if op == "=" else ~is_empty(cell)
        raise ValueError(f"{op} takes a value")
    if op == "LIKE":
        return F.coalesce(F.contains(F.lower(_text(cell, dtype)), F.lower(F.lit(literal(value)))), F.lit(False))
    if compare == "numeric" and isinstance(value, (int, float)) and not isinstance(value, bool):
        # typed columns are compared as they are, so that the scan gets the filter
        left, right = (number(cell, dtype, "skip") if dtype == "string" else cell), F.lit(value)
    elif dtype in ("int", "bigint", "smallint", "tinyint") and op in ("=", "!=") and literal(value).lstrip("-").isdigit() and str(int(literal(value))) == literal(value):
        left, right = cell, F.lit(int(literal(value)))
    else:
        left, right = _text(cell, dtype), F.lit(literal(value))
    found = {"=": left == right, "!=": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op]
    return found if op != "!=" and not isinstance(value, float) else F.coalesce(found, F.lit(False))


def _text(cell: Column, dtype: str) -> Column:
    return cell if dtype == "string" else cell.cast("string")


def columns_of(tree: object) -> list[str]:
    """Columns that a condition names."""
    if not isinstance(tree, dict):
        return []
    return [x for c in tree["children"] for x in columns_of(c)] if tree["operator"] in ("AND", "OR") else [str(tree.get("column"))]


def equalities(tree: object) -> dict[str, str]:
    """Lower-cased columns and values of the equalities that every matching row meets: a top equality, or those under ANDs from the top."""
    if not isinstance(tree, dict):
        return {}
    if tree["operator"] == "=" and tree.get("value") is not None:
        return {str(tree["column"]).lower(): literal(tree.get("value", ""))}
    if tree["operator"] == "AND":
        return {k: v for c in tree["children"] for k, v in equalities(c).items()}
    return {}
