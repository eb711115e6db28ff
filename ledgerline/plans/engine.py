"""The entry point: tables from files or frames."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.index import IndexCatalog, _write_text, read_text
from ..operators.overlay import load_updates, save_updates
from ..sources.delimited import append_delimited, read_delimited, read_records, read_with_locators
from .conditions import resolve
from .query import Query, with_constants


class Engine:
    """Tables by path: delimited files, or Parquet, ORC and JSON by their ending. Indexes are kept under index_dir.

    Cells of delimited files may hold line feeds in quotes; multi_line=False says that none does, which saves large files a shuffle.
    """

    def __init__(self, spark: SparkSession, index_dir: str | None = None, sep: str = ",", compare: str = "text", nulls: str = "zero", multi_line: bool = True):
        self.spark, self.index_dir, self.sep, self.compare, self.nulls, self.multi_line = spark, index_dir, sep, compare, nulls, multi_line

    def read(self, path: str, locators: bool = False, catalog: IndexCatalog | None = None) -> DataFrame:
        end = path.rstrip("/").rpartition(".")[2].lower()
        if end in ("parquet", "orc", "json"):
            # a fresh catalog knows the schema, which saves a look at the files
            known = catalog.fresh().get("schema") if catalog and end == "parquet" else None
            reader = self.spark.read.schema(T.StructType.fromJson(json.loads(known))) if known else self.spark.read
            return reader.format(end).load(path)
        if locators:
            return read_with_locators(self.spark, path, self.sep)
        return read_records(self.spark, path, self.sep) if self.multi_line else read_delimited(self.spark, path, self.sep)

    def catalog(self, path: str) -> IndexCatalog | None:
        """The indexes of a path: in a folder by its name and a hash of all of it."""
        name = path.rstrip("/").rpartition("/")[2].rpartition(".")[0] + "-" + hashlib.sha1(path.rstrip("/").encode()).hexdigest()[:12]
        return IndexCatalog(self.spark, f"{self.index_dir.rstrip('/')}/{name}", path) if self.index_dir else None

    def find(self, table: str | DataFrame, locators: bool = False) -> Query:
        """A query over a path or a frame. A delimited file's updates (<name>_updates.json) and virtual columns apply."""
        if isinstance(table, DataFrame):
            return Query(table, compare=self.compare, nulls=self.nulls)
        updates, catalog = self.updates_of(table), self.catalog(table)
        df = self.read(table, locators or bool(updates), catalog)
        return Query(df, compare=self.compare, nulls=self.nulls, catalog=catalog, updates=tuple(updates.items()), virtual=tuple(self.virtual_of(table).items()))

    query = find

    def _side(self, path: str, kind: str) -> str | None:
        """A delimited file's sidecar: <name>_<kind>.json, or <name>.csv_<kind>.json."""
        if not path.lower().endswith(".csv"):
            return None
        first, second = f"{path[:-4]}_{kind}.json", f"{path}_{kind}.json"
        return first if read_text(self.spark, first) is not None or read_text(self.spark, second) is None else second

    def updates_of(self, path: str) -> dict:
        side = self._side(path, "updates")
        return load_updates(self.spark, side) if side and read_text(self.spark, side) is not None else {}

    def save_updates(self, path: str, updates: dict[int, dict[str, str]]) -> None:
        """Writes a delimited file's updates, {line: {column: value}}, in place of those it had."""
        side = self._side(path, "updates")
        if side is None:
            raise ValueError("only .csv files have updates")
        save_updates(self.spark, side, updates)

    def virtual_of(self, path: str) -> dict[str, str]:
        """The virtual columns of <name>_schema.json, {"virtual_columns": {name: value}}."""
        side = self._side(path, "schema")
        text = read_text(self.spark, side) if side else None
        return {str(k): str(v) for k, v in (json.loads(text).get("virtual_columns") or {}).items()} if text else {}

    def save_schema(self, path: str, columns: dict[str, str]) -> None:
        """Writes a delimited file's virtual columns."""
        side = self._side(path, "schema")
        if side is None:
            raise ValueError("only .csv files have a schema")
        _write_text(self.spark, side, json.dumps({"virtual_columns": columns}))

    def create_index(self, path: str, columns: list, covering: bool = True) -> dict:
        """An index on columns: ["a", "b"] is composite. Rows of delimited files keep their locators in it; covering=False keeps only these and the key."""
        catalog = self.catalog(path)
        if catalog is None:
            raise ValueError("no index_dir given")
        return catalog.create(self.read(path, locators=True), list(columns), covering=covering)

    def with_virtual(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        """df with constant columns, where it has none of the name."""
        return with_constants(df, columns)

    def append(self, df: DataFrame, path: str) -> None:
        append_delimited(df, path, self.sep)

    def validate(self, path: str, columns: list[str]) -> list[str]:
        df = self.read(path)
        return [resolve(df, c) for c in columns]
