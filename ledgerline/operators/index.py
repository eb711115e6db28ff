"""Sorted side tables: an index holds a table's key columns, or all of them, ranged and sorted by its key, so that key lookups skip files and row groups."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.conditions import quoted, resolve
from ..sources.delimited import files_of

#: Bytes of a file's beginning, middle and end that a fingerprint reads.
SAMPLE = 512 * 1024


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, path: str) -> dict:
    """Size, time and a SHA-1 over names, sizes and times of the source's files and the beginning, middle and end of the first, middle and last file."""
    jvm, files = spark._jvm, files_of(spark, path)
    digest = hashlib.sha1(json.dumps([(f.rpartition("/")[2], *rest) for f, *rest in files]).encode())
    for name, size, _ in sorted({files[k] for k in (0, len(files) // 2, -1)}) if files else []:
        target, fs = _fs(spark, name)
        for start in sorted({0, max(0, (size - SAMPLE) // 2), max(0, size - SAMPLE)}):
            stream = fs.open(target)
            try:
                # the bytes stay in the JVM
                stream.seek(start)
                digest.update(jvm.org.apache.commons.codec.digest.DigestUtils.sha1Hex(jvm.org.apache.commons.io.input.BoundedInputStream(stream, SAMPLE)).encode())
            finally:
                stream.close()
    return {"size": sum(f[1] for f in files), "mtime": max((f[2] for f in files), default=0), "hash": digest.hexdigest()}


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    target, fs = _fs(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, read by the driver; None where there is none."""
    target, fs = _fs(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class IndexCatalog:
    """The indexes of one table under one folder, with their metadata in meta.json. A source that changed makes them stale: they are ignored."""

    def __init__(self, spark: SparkSession, folder: str, source: str | None):
        self.spark, self.folder, self.source = spark, folder.rstrip("/"), source

    def meta(self) -> dict:
        text = read_text(self.spark, f"{self.folder}/meta.json")
        return json.loads(text) if text else {"indexes": {}}

    def create(self, df: DataFrame, columns: list[str], bloom: bool = True, covering: bool = True) -> dict:
        """Builds the index on `columns` (several: composite) and records it. One that isn't covering holds only the key and, of delimited files, locators.

        A source that changes meanwhile is an error, and the index is not recorded.
        """
        names = [resolve(df, c) for c in columns]
        key = "__".join(n.lower() for n in names)
        where = f"{self.folder}/{key}"
        before = fingerprint(self.spark, self.source) if self.source else None
        tie = [quoted("offset")] if "offset" in df.columns else []
        held = df.columns if covering else [*names, *[c for c in ("offset", "line") if c in df.columns and c not in names]]
        out = df.select(*map(quoted, held))
        ranged = out.repartitionByRange(*map(quoted, names)).sortWithinPartitions(*map(quoted, names), *tie).write.mode("overwrite")
        for n in names if bloom else []:
            ranged = ranged.option(f"parquet.bloom.filter.enabled#{n}", "true")
        ranged.parquet(where)
        # the key columns alone are read again
        groups = self.spark.read.schema(out.schema).parquet(where).groupBy(*map(quoted, names)).agg(F.count(F.lit(1)).alias("n"))
        found = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys")).first()
        now = fingerprint(self.spark, self.source) if self.source else None
        if now != before:
            raise ValueError(f"{self.source} changed while it was indexed")
        meta = self.meta()
        if meta.get("source") != now:
            meta = {"indexes": {}}
        meta |= {"capturedAt": datetime.now(timezone.utc).isoformat(), "totalRows": found["rows"], "source": now, "schema": df.schema.json()}
        meta["indexes"][key] = {"columns": names, "distinctCount": found["keys"], "fileSize": sum(f[1] for f in files_of(self.spark, where)), "schema": out.schema.json()}
        _write_text(self.spark, f"{self.folder}/meta.json", json.dumps(meta))
        return meta

    def fresh(self) -> dict:
        """Metadata, if there is any and the source is as it was."""
        meta = self.meta()
        if not meta["indexes"] or (self.source and meta.get("source") != fingerprint(self.spark, self.source)):
            return {"indexes": {}}
        return meta

    def best(self, equal: dict[str, str], group: list[str] = (), needed: list[str] | None = None) -> tuple[str, DataFrame] | None:
        """The index whose columns are the largest subset of the equality columns; else one that leads with the group's columns. It holds all the needed columns, and the whole condition is still applied to it."""
        found = {k: (v["columns"], T.StructType.fromJson(json.loads(v["schema"]))) for k, v in self.fresh()["indexes"].items()}
        found = {k: v for k, v in found.items() if needed is None or {c.lower() for c in needed} <= {c.lower() for c in v[1].names}}
        # of equal ones, that with fewer columns to read
        fits = [(len(c), -len(s), k) for k, (c, s) in found.items() if {x.lower() for x in c} <= equal.keys()]
        if not fits and group:
            fits = [(1, -len(s), k) for k, (c, s) in found.items() if [x.lower() for x in c[: len(group)]] == [g.lower() for g in group]]
        if not fits:
            return None
        key = max(fits)[2]
        return key, self.spark.read.schema(found[key][1]).parquet(f"{self.folder}/{key}")
