"""Delimited text files as tables of text columns, with row locators on request, and the append sink."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Names in the first line, trimmed, without quotes and byte order mark; [] for an empty file."""
    line = spark.read.option("lineSep", "\n").text(path).first()
    if line is None or not line[0].strip(BOM + "\r\n "):
        return []
    text = line[0].lstrip(BOM).rstrip("\r")
    cells = next(csv.reader(io.StringIO(text.replace(sep, "\x1f") if len(sep) > 1 else text), delimiter="\x1f" if len(sep) > 1 else sep))
    return [c.strip().replace('"', "") for c in cells]


def _physical(names: list[str]) -> tuple[list[str], list[str]]:
    """A distinct name for each place, and the names that stay: of equal names, whatever their case, the last."""
    last = {n.lower(): i for i, n in enumerate(names)}
    physical = [n if last[n.lower()] == i else f"_hidden_{i}" for i, n in enumerate(names)]
    return physical, [n for i, n in enumerate(names) if last[n.lower()] == i]


def read_delimited(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """All columns as text; empty and missing cells are null. Blank lines are skipped, extra cells ignored."""
    names = header_of(spark, path, sep)
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    physical, shown = _physical(names)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in physical])
    df = spark.read.csv(path, schema=schema, header=True, sep=sep, quote='"', escape='"', multiLine=multi_line, enforceSchema=True, mode="PERMISSIVE")
    return df.select(*[F.col(f"`{n}`") for n in shown])


def read_with_locators(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The table with `offset` (byte) and `line` (number of the record, header = 1; blank lines count) of each row.

    Files are read in splits. A line starts a record if the quotes before it are even in number: each split counts its own, and the counts of
    splits, one row each, are all that meets in one task. A record of several lines is put together again; one that a file's end cuts off is not a row.
    """
    names = header_of(spark, path, sep)
    if not names:
        return spark.createDataFrame([], "offset long, line long")
    physical, shown = _physical(names)
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("_start"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id"))
    raw = raw.withColumn("_bytes", F.octet_length("value") + 1).withColumn("_quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    before = Window.partitionBy("_file", "_start").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_file", "_start").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = raw.withColumn("_q0", F.coalesce(F.sum("_quotes").over(before), F.lit(0))).withColumn("_byte", F.coalesce(F.sum("_bytes").over(before), F.lit(0)))
    rows = rows.withColumn("_even", F.sum((F.col("_q0") % 2 == 0).cast("int")).over(upto)).withColumn("_odd", F.sum((F.col("_q0") % 2).cast("int")).over(upto))
    splits = rows.groupBy("_file", "_start").agg(F.sum("_bytes").alias("_size"), F.sum("_quotes").alias("_all"), F.max("_even").alias("_n_even"), F.max("_odd").alias("_n_odd"))
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_open", F.coalesce(F.sum("_all").over(earlier), F.lit(0)) % 2)
    splits = splits.select("_file", "_start", "_open", F.coalesce(F.sum(F.when(F.col("_open") == 0, F.col("_n_even")).otherwise(F.col("_n_odd"))).over(earlier), F.lit(0)).alias("_line0"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_byte0"))
    rows = rows.join(splits, ["_file", "_start"]).withColumn("line", F.col("_line0") + F.when(F.col("_open") == 0, F.col("_even")).otherwise(F.col("_odd")))
    rows = rows.withColumn("offset", F.col("_byte0") + F.col("_byte") + F.when(F.col("line") > 1, _mark(spark, path)).otherwise(0)).withColumn("_starts", (F.col("_open") + F.col("_q0")) % 2 == 0).withColumn("_ends", (F.col("_open") + F.col("_q0") + F.col("_quotes")) % 2 == 0)
    parts = rows.filter(~(F.col("_starts") & F.col("_ends"))).groupBy("_file", "line").agg(F.min("offset").alias("offset"), F.sum("_quotes").alias("_quotes"), F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("_parts"))
    parts = parts.filter("_quotes % 2 = 0").select(F.array_join(F.col("_parts.value"), "\n").alias("value"), "offset", "line")
    rows = rows.filter(F.col("_starts") & F.col("_ends")).select("value", "offset", "line").unionByName(parts)
    rows = rows.filter((F.col("line") > 1) & (F.trim(F.col("value"), F.lit(" \r")) != ""))
    schema = ", ".join(f"`{n}` string" for n in physical)
    rows = rows.withColumn("_r", F.from_csv(F.regexp_replace("value", "\\r$", ""), F.lit(schema), {"sep": sep, "escape": '"', "multiLine": "true"}))
    return rows.select(*[F.col(f"_r.`{n}`").alias(n) for n in shown], F.col("offset").cast("long").alias("offset"), F.col("line").cast("long").alias("line"))


def read_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The table, cells with line feeds included. Files of a split or less are read by a task each; larger ones in splits."""
    most = int(spark.conf.get("spark.sql.files.maxPartitionBytes").lower().rstrip("b")) if spark.conf.get("spark.sql.files.maxPartitionBytes").lower().rstrip("b").isdigit() else 128 << 20
    if any(c in path for c in "*?[{") or max((size for _, size, _ in files_of(spark, path)), default=0) > most:
        df = read_with_locators(spark, path, sep)
        return df.drop("offset", "line")
    return read_delimited(spark, path, sep, True)


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, size, time) of a file, or of the files of a folder but hidden ones, sorted."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files, todo = [], [fs.getFileStatus(target)] if fs.exists(target) else []
    while todo:
        s = todo.pop()
        if s.isDirectory():
            todo += list(fs.listStatus(s.getPath()))
        elif not s.getPath().getName().startswith(("_", ".")):
            files.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(files)


def _mark(spark: SparkSession, path: str) -> int:
    """Bytes of the byte order mark, which the text reader drops."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target) or fs.getFileStatus(target).isDirectory():
        return 0
    stream = fs.open(target)
    try:
        return 3 if [stream.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF] else 0
    finally:
        stream.close()


def append_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """Appends df to a folder of delimited files that all have df's columns; another header is an error."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        status = [s for s in fs.listStatus(target) if s.getPath().getName().startswith("part-") and s.getLen() > 0]
        if status and (found := header_of(spark, status[0].getPath().toString(), sep)) != df.columns:
            raise ValueError(f"header mismatch: {found} in {path}, {df.columns} given")
    df.write.mode("append").option("header", True).option("sep", sep).option("escape", '"').csv(path)
