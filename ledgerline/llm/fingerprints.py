"""8. Document fingerprints [native]: one-permutation MinHash.

Each run of five words is hashed once. The hash's leading bits name a bin, and
a bin keeps its least hash. An empty bin takes the value of the first full bin
in a probe order of its own, the same for all documents (optimal
densification), hashed with the empty bin's number so that copies of one value
don't agree or differ together. The low four bits of each bin are kept, a hex
digit a bin, and the likeness of two fingerprints is corrected for digits that
agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table, words

SHINGLE = 5
BITS = 8
BINS = 1 << BITS
DIGIT_BITS = 4
PROBES = 16
EMPTY = "-" * BINS


def _mixed(x: int) -> int:
    """A 64-bit finaliser for the fixed probe orders."""
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


# bin i probes (start[i] + t * step[i]) mod BINS for t = 0, 1, ...; odd steps reach every bin
_START = [_mixed(2 * i) % BINS for i in range(BINS)]
_STEP = [_mixed(2 * i + 1) % BINS | 1 for i in range(BINS)]
_BACK = [pow(s, -1, BINS) for s in _STEP]


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def fingerprint(text: Column) -> Column:
    """BINS hex digits, or as many hyphens for a text without words. Texts of fewer than SHINGLE words are one shingle."""
    # the greatest value of each bin is always there, so that every bin has one; a bin that holds nothing else is empty
    low = 64 - BITS
    tops = F.array(*[F.lit(_signed(((b - BINS // 2 + 1) << low) - 1)) for b in range(BINS)])
    flags = F.lit((1 << low) - 1)
    starts, steps, backs = (F.array(*[F.lit(v) for v in x]) for x in (_START, _STEP, _BACK))

    def of_words(w: Column) -> Column:
        hashes = F.when(F.size(w) < SHINGLE, F.array(F.xxhash64(w))).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(SHINGLE)))))
        return let(F.sort_array(F.concat(hashes, tops)), of_sorted)

    def of_sorted(h: Column) -> Column:
        least = F.filter(h, lambda x, i: (i == 0) | (F.shiftright(x, low) != F.shiftright(F.get(h, i - 1), low)))
        return let(least, of_bins)

    def of_bins(bins: Column) -> Column:
        # null: empty
        values = F.transform(bins, lambda x: F.when(x.bitwiseAND(flags) == flags, F.lit(None).cast("long")).otherwise(x))
        return let(values, lambda v: let(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(v, b).isNotNull()), lambda full: dense(v, full)))

    def dense(v: Column, full: Column) -> Column:
        def probed(i: Column) -> Column:
            tries = F.filter(F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda t: F.get(v, (F.get(starts, i) + t * F.get(steps, i)) % BINS)), lambda x: x.isNotNull())
            # beyond the first probes: of the full bins, the one that comes first in this bin's order
            rank = lambda b: F.pmod((b - F.get(starts, i)) * F.get(backs, i), F.lit(BINS))
            last = F.get(v, F.array_min(F.transform(full, lambda b: rank(b) * BINS + b)) % BINS)
            few = F.size(full) * PROBES < BINS
            return F.when(few, last).otherwise(F.coalesce(F.get(tries, F.lit(0)), last))

        filled = F.when(F.size(full) == BINS, v).otherwise(F.transform(v, lambda x, i: F.coalesce(x, F.xxhash64(probed(i), i))))
        return F.array_join(F.transform(filled, lambda x: F.substring(F.lit("0123456789abcdef"), x.bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int") + 1, F.lit(1))), "")

    return let(words(text), lambda w: F.when(F.size(w) == 0, F.lit(EMPTY)).otherwise(of_words(w)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingles, 0 to 1. Equal fingerprints give 1; one without words is unlike any other."""
    chance = 1.0 / (1 << DIGIT_BITS)
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    return F.when(a == b, F.lit(1.0)).when((a == EMPTY) | (b == EMPTY), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (same / F.lit(BINS) - chance) / (1 - chance)))


def _position(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are at most value, by binary search; bounds are few and fixed."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    # one folded literal, however many they are
    padded = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when(F.get(padded, lo + s - 1) <= value, lo + s).otherwise(lo))


def with_next_text(docs: DataFrame, n_bounds: int | None = None) -> DataFrame:
    """docs (doc_id, text, fingerprint) and next_text, next_fingerprint: of the next document by descending doc_id, after the last the first.

    Rows are dealt out by quantiles of doc_id, at most n_bounds of them (8 for each shuffle partition). Each share finds its neighbours
    alone; the last row of a share takes the first text of the next share. Only those first ids, one a share, are broadcast.
    Rows of equal doc_id go by text; null ids come last.
    """
    spark = docs.sparkSession
    n_bounds = n_bounds or max(256, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = F.array(*[F.lit(i / n_bounds) for i in range(1, n_bounds)])
    bounds = sorted(set(docs.select(F.percentile_approx("doc_id", marks, 50 * n_bounds).alias("q")).first()["q"] or []))
    share = -_position(bounds, F.col("doc_id"))
    near = Window.partitionBy("_share").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    rows = docs.withColumn("_share", share)
    ids = docs.select("doc_id", share.alias("_share")).groupBy("_share").agg(F.max("doc_id").alias("_top"))  # len(bounds) + 1 rows at most
    whole = Window.orderBy("_share")
    after = ids.withColumn("_to", F.coalesce(F.lag("_share").over(whole), F.max("_share").over(Window.partitionBy()))).select("_share", F.col("_to").alias("_from"))
    # _from takes what _share starts with; a share without any id but null starts with its least text
    firsts = docs.select("doc_id", "text", share.alias("_share")).join(F.broadcast(ids), "_share").filter(F.col("doc_id").eqNullSafe(F.col("_top")))
    firsts = firsts.groupBy("_share").agg(F.min(F.coalesce("text", F.lit(""))).alias("_first"))
    links = after.join(firsts, "_share").select(F.col("_from").alias("_share"), "_first")
    rows = rows.withColumn("_next", F.lead(F.struct("text", "fingerprint")).over(near))
    rows = rows.join(links, "_share", "left")
    next_text = F.coalesce(F.when(F.col("_next").isNotNull(), F.coalesce("_next.text", F.lit(""))), F.col("_first"))
    # the fingerprint of a first text is computed anew, for one row a share
    return rows.withColumn("next_text", next_text).withColumn("next_fingerprint", F.when(F.col("_next").isNotNull(), F.col("_next.fingerprint")).otherwise(fingerprint(F.col("_first")))).drop("_share", "_next", "_first")


def edited(text: Column, next_text: Column) -> Column:
    """text, its last floor(n / 3) code points replaced by the first as many (or all) of next_text."""
    n = F.char_length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(next_text, F.lit(1), k))


def fingerprints(docs: DataFrame, n_bounds: int | None = None) -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty. Texts without words have a fingerprint of hyphens, alike to each other only. A lone document is its
    own next. An empty table gives no rows; other columns of docs are not read. Lower- and upper-case words differ.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next_text(base.withColumn("fingerprint", fingerprint(F.col("text"))), n_bounds)
    rows = rows.withColumn("_edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("_edited")))
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
