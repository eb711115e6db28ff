"""7. Exact dedup [native]: an extendible-hash index on shared files.

The hash of a normalised text (A-Z lower-cased) is its key. A directory of
buckets, each the keys that share its leading bits, doubles where a bucket is
overfull: the bucket splits by the next bit, again and again, until all fit.
Every row finds its bucket through the directory. Texts whose key occurs once
are entries as they are; the others go to their bucket's owner, which compares
their bytes and chains unequal texts of one key. The index is written ranged by
bucket and key, so an owner task holds a range of keys, and each row is looked
up in its bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, hot_join, table, written

#: Keys of a bucket.
CAPACITY = 4096
KEY_BITS = 64


def _prefix(depth: int) -> Column:
    """The `depth` leading bits of the key h."""
    return F.shiftright("h", KEY_BITS - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(depth, prefix, load): the buckets that a directory of keys (h, distinct) ends with.

    It starts with 2 ** depth buckets, as many as full ones would be, and each round splits the overfull ones: only their keys are
    counted again. A bucket of KEY_BITS bits holds one key and can't split.
    """
    depth, found = max(0, math.ceil(math.log2(max(1, keys.count()) / capacity))), None
    while True:
        cells = written(keys.groupBy(_prefix(depth).alias("prefix")).agg(F.count(F.lit(1)).alias("load")).select(F.lit(depth).alias("depth"), "prefix", "load"), "exact-buckets")
        over = cells.filter(F.col("load") > capacity) if depth < KEY_BITS else cells.limit(0)
        fit = cells.join(over.select("prefix"), "prefix", "left_anti").select("depth", "prefix", "load")
        found = fit if found is None else found.unionByName(fit)
        if over.isEmpty():
            return written(found, "exact-directory")
        keys, depth = keys.withColumn("prefix", _prefix(depth)).join(over.select("prefix"), "prefix", "left_semi").select("h"), depth + 1


def routed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows (h, ...) with depth and bucket, the least key that their bucket may hold. The directory has a few depths, each one join."""
    depths = [r["depth"] for r in buckets.select("depth").distinct().orderBy("depth").collect()]
    if depths in ([], [0]):
        return rows.withColumns({"depth": F.lit(0), "bucket": F.lit(-(1 << 63))})
    for d in depths:
        rows = rows.withColumn("_p", _prefix(d)).join(buckets.filter(F.col("depth") == d).select(F.col("prefix").alias("_p"), F.lit(d).alias(f"_at{d}")), "_p", "left").drop("_p")
    rows = rows.withColumn("depth", F.coalesce(*[f"_at{d}" for d in depths])).drop(*[f"_at{d}" for d in depths])
    return rows.withColumn("bucket", F.when(F.col("depth") == 0, F.lit(-(1 << 63))).otherwise(F.expr(f"shiftleft(shiftright(h, {KEY_BITS} - depth), {KEY_BITS} - depth)")))


def _keyed(docs: DataFrame, id_col: str, text_col: str, hash_bits: int) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    h = F.xxhash64(norm)
    mask = ((1 << hash_bits) - 1) << (64 - hash_bits)
    mask -= (1 << 64) if mask >= 1 << 63 else 0
    return docs.select(F.col(id_col).cast("long").alias("_id"), norm.alias("norm"), (h if hash_bits == 64 else h.bitwiseAND(F.lit(mask))).alias("h"))


def build_index(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The directory, and the index on shared files: (bucket, depth, h, rows, chain), chain a (sha, n, keep_id) for each distinct text of the key.

    rows (_id, h, sha) are those of docs. Copies meet in the map-side part of the grouping, so a text that a third of all rows share is
    shuffled once a task.
    """
    keys = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.max("_id").alias("keep_id"), F.max("sha").alias("sha")), "exact-keys")
    buckets = directory(keys.select("h"), capacity)
    single = keys.filter("rows = 1").select("h", "rows", F.array(F.struct("sha", F.col("rows").alias("n"), "keep_id")).alias("chain"))
    # the owners: grouping by the text itself compares bytes, so equal keys with unequal texts stay apart
    texts = hot_join(_keyed(docs, id_col, text_col, hash_bits), written(keys.filter("rows > 1").select("h", "rows"), "exact-shared"), ["h"], "rows")
    entries = texts.groupBy("h", "rows", "norm").agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("keep_id")).select("h", "rows", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "n", "keep_id")
    chains = entries.groupBy("h", "rows").agg(F.collect_list(F.struct("sha", "n", "keep_id")).alias("chain"))
    owned = routed(single.unionByName(chains), buckets).repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h")
    return buckets, written(owned.select("bucket", "depth", "h", "rows", "chain"), "exact-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
    doc_id stays; a null doc_id ranks below all others. Rows that repeat that doc_id as well are all marked kept, and each counts
    in group_size. An empty table gives no rows; other columns of docs are not read. hash_bits under 64 makes keys collide, for tests.
    """
    rows = written(_keyed(docs, id_col, text_col, hash_bits).select("_id", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha")), "exact-rows")
    buckets, index = build_index(docs, rows, id_col, text_col, capacity, hash_bits)
    own = F.filter("chain", lambda e: e["sha"] == F.col("sha"))
    # two texts of one chain with equal digests could not be told apart here; none are known
    own = F.when(F.size(own) == 1, F.get(own, F.lit(0))).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")))
    found = hot_join(routed(rows, buckets), index.drop("depth"), ["bucket", "h"], "rows").select("_id", "sha", own.alias("e"))
    return found.select(F.col("_id").alias("doc_id"), F.col("e.keep_id").alias("keep_id"), F.col("e.n").alias("group_size"), F.col("_id").eqNullSafe(F.col("e.keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
