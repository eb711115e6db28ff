"""The fluent query: immutable, compiled to one DataFrame plan when it runs."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.values import number
from ..operators.aggregate import expression, grouped
from ..operators.index import IndexCatalog
from ..operators.overlay import apply_updates
from .conditions import columns_of, compile_condition, equalities, parse, quoted, resolve


#: Groups that `count` and `groups_json` give as one value at most; a DataFrame holds any number.
MOST_GROUPS = 1_000_000


def with_constants(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with constant columns, where it has none of the name."""
    have = {c.lower() for c in df.columns}
    new = {k: F.lit(v) for k, v in columns.items() if k.lower() not in have}
    return df.withColumns(new) if new else df


@dataclass(frozen=True)
class Query:
    df: DataFrame
    condition: object = None
    columns: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    func: str | None = None
    column: str | None = None
    order: tuple[tuple[str, str], ...] = ()
    n_limit: int = 0
    n_offset: int = 0
    compare: str = "text"
    nulls: str = "zero"
    alias: str = "value"
    catalog: IndexCatalog | None = None
    updates: tuple = ()
    virtual: tuple = ()

    def select(self, *columns: str | list[str]) -> Query:
        flat = [c for x in columns for c in (x if isinstance(x, (list, tuple)) else [x])]
        return replace(self, columns=tuple(flat))

    def where(self, condition: object) -> Query:
        return replace(self, condition=parse(condition))

    def _with(self, op: str, condition: object) -> Query:
        new = parse(condition)
        if new is None or self.condition is None:
            return replace(self, condition=new if self.condition is None else self.condition)
        return replace(self, condition={"operator": op, "children": [self.condition, new]})

    def and_where(self, condition: object) -> Query:
        return self._with("AND", condition)

    def or_where(self, condition: object) -> Query:
        return self._with("OR", condition)

    def group_by(self, *keys: str | list[str]) -> Query:
        flat = [c for x in keys for c in (x.split(",") if isinstance(x, str) else x)]
        return replace(self, keys=tuple(k.strip() for k in flat))

    def aggregate(self, func: str, column: str | None = None, alias: str = "value") -> Query:
        return replace(self, func=func or "distinct", column=column, alias=alias)

    def order_by(self, order: dict[str, str] | str, direction: str = "ASC") -> Query:
        pairs = order.items() if isinstance(order, dict) else [(order, direction)]
        return replace(self, order=self.order + tuple((c, str(d).upper()) for c, d in pairs))

    def limit(self, n: int) -> Query:
        return replace(self, n_limit=int(n))

    def offset(self, n: int) -> Query:
        return replace(self, n_offset=int(n))

    def numeric(self) -> Query:
        """Compare numbers as numbers from here on, not as text."""
        return replace(self, compare="numeric")

    def _needed(self, counting: bool) -> list[str]:
        """Columns that the query reads."""
        if self.keys or self.func or counting:
            return [c for c in (*columns_of(self.condition), *self.keys, *([self.column] if self.column else [])) if c not in dict(self.virtual)]
        return self.df.columns

    def _index(self, counting: bool = False) -> tuple[str, DataFrame] | None:
        # updated cells may match where the index's don't: scan
        if self.updates or self.catalog is None or (self.condition is None and not self.keys):
            return None
        return self.catalog.best(equalities(self.condition), list(self.keys), self._needed(counting))

    def _base(self, counting: bool = False) -> DataFrame:
        df = self.df
        if self.updates:
            df = apply_updates(df, dict(self.updates))
        else:
            found = self._index(counting)
            if found is not None:
                df = found[1].select(*[quoted(c) for c in df.columns if c in found[1].columns])
        return with_constants(df, dict(self.virtual))

    def _rows(self, counting: bool = False) -> DataFrame:
        df = self._base(counting)
        condition = compile_condition(df, self.condition, self.compare)
        return df if condition is None else df.filter(condition)

    def _cut(self, df: DataFrame, default: list[str] = ()) -> DataFrame:
        """Order, then offset and limit. Without an order, offset and limit go by `default` where the frame has it.

        After `numeric()` text cells go by their numbers, those that are none first, and then as text.
        """
        order, types = [(resolve(df, c), d) for c, d in self.order], dict(df.dtypes)
        if order:
            keys = [(k, d) for c, d in order for k in ([number(quoted(c), "string", "skip"), quoted(c)] if self.compare == "numeric" and types[c] == "string" else [quoted(c)])]
            df = df.orderBy(*[k.desc() if d == "DESC" else k.asc() for k, d in keys])
        elif (self.n_limit > 0 or self.n_offset > 0) and default:
            df = df.orderBy(*map(quoted, default))
        if self.n_offset > 0:
            df = df.offset(self.n_offset)
        return df.limit(self.n_limit) if self.n_limit > 0 else df

    def all(self) -> DataFrame:
        """The result: rows, groups or one row of a global aggregate."""
        df = self._rows()
        if self.keys:
            out = grouped(df, list(self.keys), self.func or "distinct", self.column, self.alias, self.nulls)
            return self._cut(out, [resolve(df, k) for k in self.keys])
        if self.func:
            return df.agg(expression(df, self.func, self.column, self.nulls).alias(self.alias))
        df = self._cut(df, ["line"] if "line" in df.columns else [])
        return df.select(*[quoted(resolve(df, c)) for c in self.columns]) if self.columns else df

    to_df = all

    def one(self) -> Row | None:
        return replace(self, n_limit=1).all().first()

    def first_row(self) -> DataFrame:
        return replace(self, n_limit=1).all()

    def locators(self) -> DataFrame:
        """(offset, line) of the matching rows."""
        return self._cut(self._rows(), ["line"]).select("offset", "line")

    def count_df(self) -> DataFrame:
        """One row: the matches, or with group_by the count of each group; offset and limit apply before counting rows."""
        if self.keys:
            return self.aggregate("count", alias="count").all()
        df = self._rows(counting=True)
        if self.n_limit > 0 or self.n_offset > 0:
            df = self._cut(df.select(*([quoted("line")] if "line" in df.columns else [])), ["line"] if "line" in df.columns else [])
        return df.agg(F.count(F.lit(1)).alias("count"))

    def count(self) -> int | dict:
        """Number of matches; with group_by {group: count}. An unfiltered count comes from fresh index metadata."""
        if self.keys:
            return {r[0] if len(self.keys) == 1 else tuple(r[:-1]): r["count"] for r in self._few(self.count_df())}
        if self.catalog is not None and self.condition is None and not self.updates and self.n_limit <= 0 and self.n_offset <= 0 and "totalRows" in (meta := self.catalog.fresh()):
            return meta["totalRows"]
        return self.count_df().first()["count"]

    @staticmethod
    def _few(groups: DataFrame) -> list[Row]:
        found = groups.limit(MOST_GROUPS + 1).collect()
        if len(found) > MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} groups: use the DataFrame")
        return found

    def groups_json(self) -> str:
        """The groups as one JSON object {group: value}, ordered by group; the parts of several keys are joined by commas."""
        text = lambda v: "" if v is None else str(v)
        found = {",".join(text(v) for v in r[:-1]): r[-1] for r in self._few(self.all())}
        return json.dumps(found, sort_keys=True, ensure_ascii=False)

    def _global(self, func: str, column: str) -> float | None:
        return replace(self, keys=()).aggregate(func, column).all().first()["value"]

    def sum(self, column: str) -> float | None:
        return self._global("sum", column)

    def avg(self, column: str) -> float | None:
        return self._global("avg", column)

    def min(self, column: str) -> float | None:
        return self._global("min", column)

    def max(self, column: str) -> float | None:
        return self._global("max", column)

    def distinct(self, column: str) -> DataFrame:
        return replace(self, keys=(column,), func="distinct", column=None).all().drop(self.alias)

    def explain(self) -> str:
        """The index that serves the query, if any, and Catalyst's plan."""
        found = self._index()
        return f"Index: {found[0] if found else 'none'}\n{self.all()._jdf.queryExecution().toString()}"
