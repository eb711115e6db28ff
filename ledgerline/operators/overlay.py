"""Point updates: cells replaced by line number before any filter."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.conditions import quoted

#: Updates up to this many rows are broadcast; more are joined by shuffle.
MOST_BROADCAST = 100_000


def load_updates(spark: SparkSession, path: str) -> dict[int, dict[str, str]]:
    """{line: {column: value}} of a sidecar {"rows": {"<line>": {"<column>": "<value>"}}}, by any path that Spark reads."""
    text = spark.read.option("wholetext", True).text(path).first()
    return {int(k): {c.lower(): v for c, v in cells.items()} for k, cells in (json.loads(text[0] if text else "{}").get("rows") or {}).items()}


def save_updates(spark: SparkSession, path: str, updates: dict[int, dict[str, str]]) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(json.dumps({"rows": {str(k): v for k, v in updates.items()}}).encode()))
    finally:
        out.close()


def apply_updates(df: DataFrame, updates: dict[int, dict[str, str]], key: str = "line") -> DataFrame:
    """df with the cells of `updates` replaced; rows are found by df's `key` column, values are cast to the cell's type."""
    if not updates:
        return df
    known = {c.lower() for c in df.columns}
    unknown = {c for cells in updates.values() for c in cells} - known
    if unknown:
        raise ValueError(f"unknown columns in updates: {sorted(unknown)}")
    rows = df.sparkSession.createDataFrame([(int(k), {c: v for c, v in cells.items()}) for k, cells in updates.items()], "_line long, _cells map<string,string>")
    if len(updates) <= MOST_BROADCAST:
        rows = F.broadcast(rows)
    touched = {c for cells in updates.values() for c in cells}
    joined = df.join(rows, quoted(key).cast("long") == F.col("_line"), "left")
    types = dict(df.dtypes)
    put = lambda c: F.when(F.map_contains_key("_cells", F.lit(c.lower())), F.col("_cells")[c.lower()].cast(types[c])).otherwise(quoted(c)).alias(c)
    return joined.select(*[put(c) if c.lower() in touched else quoted(c) for c in df.columns])
