"""9. Line dedup [native]: overlapping windows of three lines.

Every three consecutive lines are hashed; windows that occur more than once in
the corpus are found by one grouping, and all occurrences but the first (by
doc_id, then place) mark the lines that they cover. Marked stretches are merged
and cut out of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, let, packed, table, unpacked, written

SPAN = 3


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(_d, _t, starts): for each document that has any, the places of windows that occurred before."""
    # a window without a visible character says nothing
    windows = let(
        F.split("text", "\n", -1),
        lambda lines: F.when(
            F.size(lines) >= SPAN,
            F.filter(
                F.transform(
                    F.sequence(F.lit(1), F.size(lines) - (SPAN - 1)),
                    lambda i: let(F.slice(lines, i, F.lit(SPAN)), lambda w: F.struct(F.xxhash64(w).alias("a"), F.xxhash64(F.lit(1), w).alias("b"), (i - 1).alias("at"), F.exists(w, lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "").alias("seen"))),
                ),
                lambda w: w["seen"],
            ),
        ),
    )
    rows = docs.filter(F.col("text").contains("\n")).select("_d", "_t", F.explode(windows).alias("w")).select("_d", "_t", "w.a", "w.b", "w.at")
    place = F.struct("_d", "_t", "at")
    # written, so that the join sees plain rows on both sides: a window that very many documents share is dealt over many tasks
    first = written(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1"), "line-windows")
    later = hot_join(rows, first, ["a", "b"], "n").filter(place != F.col("first"))
    return later.groupBy("_d", "_t").agg(F.collect_set("at").alias("starts"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with each text less its repeated lines, and n_lines, n_removed (bigint).

    A line goes if it lies in a window of three consecutive lines that occurred before, in a document of smaller doc_id or
    earlier in the same one. Lines end at line feeds and are compared as they are; windows of blank lines don't count, and texts of
    one or two lines never change. A null text stays null with 0 lines; an empty one has 1 line. A null doc_id comes before all
    others; rows with equal doc_id and text are one document and get the same text. Other columns stay as they are.
    """
    base = packed(docs, docs["text"].alias("text"))
    joined = base.join(repeated_windows(base), ["_d", "_t"], "left")

    def kept(lines, at):
        # ends of merged stretches, and their starts: what lies between them stays
        starts = F.filter(at, lambda p, i: (i == 0) | (p > F.get(at, i - 1) + SPAN))
        ends = F.transform(F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > p + SPAN)), lambda p: p + SPAN)
        gaps = F.arrays_zip(F.concat(F.array(F.lit(0)), ends).alias("from"), F.concat(starts, F.array(F.size(lines))).alias("to"))
        return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["from"] + 1, g["to"] - g["from"])))

    lines = F.split("text", "\n", -1)
    left = F.when(F.col("starts").isNull(), F.lit(None)).otherwise(let(lines, lambda x: let(F.sort_array("starts"), lambda at: kept(x, at))))
    out = joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")).withColumn("_left", left)
    n_removed = F.when(F.col("_left").isNull(), 0).otherwise(F.col("n_lines") - F.size("_left")).cast("long")
    new = {"text": F.when(F.col("_left").isNull(), F.col("text")).otherwise(F.array_join("_left", "\n"))}
    return unpacked(out, docs, new, {"n_lines": F.col("n_lines"), "n_removed": n_removed})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, i, line AS x, lead(line, 1) OVER o AS y, lead(line, 2) OVER o AS z FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, i) AS rn FROM w
  WHERE z IS NOT NULL AND regexp_matches(x || y || z, '[^ \t\x0b\x0c\r]')
), g AS (
  SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM r WHERE rn > 1
), k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS t
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
