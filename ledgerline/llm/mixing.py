"""3. Mixing sources to target weights by Sainte-Laguë apportionment.

Targets are the sources' weights scaled to the budget, each capped at a number
of passes over its source. They become integer quotas of equal blocks of tokens:
blocks go one by one to the highest quotient target / (2 k + 1) among sources,
and each source's words, by the same rule, to its shards. A seeded draw then
picks runs of each shard's words until its quota is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHITE_RUN, let, n_words, packed, table, unpacked, with_identity, written

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
PASSES = 2
#: The largest block. Blocks are as much smaller as the smallest source needs to get FEWEST_BLOCKS.
BLOCK_WORDS = 256
FEWEST_BLOCKS = 64
SHARD_WORDS = 32768
#: Shards of a source at most; beyond that shards grow. One task sorts the ids and sizes of a shard, never its texts.
MOST_SHARDS = 4096
SEED = 20
RANGES = "array<struct<start:bigint,stop:bigint>>"


def targets(sources: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, passes: float = PASSES) -> DataFrame:
    """Adds source_no, weight and target to (source, source_size). One row per source, so single-task windows are small here.

    Sources by code point, null last, take the weights in turn. With sources ordered by size / weight, those that end at their cap
    come first; the others share what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = sources.withColumn("source_no", F.row_number().over(by_name)).withColumn("weight", F.get(w, (F.col("source_no") - 1) % len(weights)))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    cap = F.col("source_size") * float(passes)
    s = s.withColumn("cap", cap).withColumn("rest", F.sum("source_size").over(whole) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("level", F.col("rest") / F.sum("weight").over(after))
    # the first source that its share doesn't fill sets the level for all after it
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("source_size") / F.col("weight"), "source_no", "level"))).over(whole)["level"])
    return s.withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))).drop("rest", "level")


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """Adds quota to parties: each group's `seats` go one by one to the highest votes / (2 k + 1); ties to the lower party.

    All quotas of n parties are round(votes / d) for one d between sum / (seats + n / 2) and sum / (seats - n / 2), so only the about 2 n
    quotients that this leaves open are ranked, however many the seats are.
    """
    whole = Window.partitionBy(*group)
    p = parties.withColumn("_sum", F.sum(votes).over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    at = lambda share: F.when(F.col("_sum") > 0, F.col(votes) * share / F.col("_sum")).otherwise(F.lit(0.0))
    least = F.greatest(F.lit(0), F.ceil(at(F.col(seats) - F.col("_n") / 2) - 0.5) - 1).cast("long")
    most = (F.floor(at(F.col(seats) + F.col("_n") / 2) + 0.5) + 1).cast("long")
    p = p.withColumn("_least", F.when(F.col(votes) > 0, least).otherwise(0)).withColumn("_most", F.when(F.col(votes) > 0, most).otherwise(0))
    p = p.withColumn("_open", F.col(seats) - F.sum("_least").over(whole))
    q = p.select(*group, party, votes, "_open", F.explode(F.when(F.col("_most") > F.col("_least"), F.sequence("_least", F.col("_most") - 1)).otherwise(F.array().cast("array<bigint>"))).alias("_k"))
    q = q.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), party, "_k")))
    won = q.filter(F.col("_rank") <= F.col("_open")).groupBy(*group, party).agg(F.count(F.lit(1)).alias("_won"))
    return p.join(won, [*group, party], "left").withColumn("quota", F.col("_least") + F.coalesce("_won", F.lit(0))).drop("_sum", "_n", "_least", "_most", "_open", "_won")


def _plan(base: DataFrame, weights: tuple, budget: float, passes: int, seed: int, block_words: int, shard_words: int) -> DataFrame:
    """What the mix takes, from base (_d, _t, source, size): a row for each (source, _d, _t) with source_size, target, rounds (whole copies) and ranges.

    Rows that agree in all three are one unit of n copies: each of its words counts n times, and all copies are taken alike.
    """
    units = base.groupBy("source", "_d", "_t", "size").agg(F.count(F.lit(1)).alias("n"))
    sources = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, passes)
    whole = Window.partitionBy()
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(whole) / FEWEST_BLOCKS))).cast("long")
    sources = sources.withColumn("block", F.coalesce(block, F.lit(1).cast("long"))).withColumn("seats", F.round(F.sum("target").over(whole) / F.col("block")).cast("long")).withColumn("_all", F.lit(0))
    sources = sainte_lague(sources, ["_all"], "source_no", "target", "seats")
    cap = F.col("source_size") * passes
    words = F.when(F.col("target") >= cap, cap).otherwise(F.least(cap, F.col("quota") * F.col("block")))
    # runs that a shard draws; a small source's are shorter
    run = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / FEWEST_BLOCKS))).cast("long")
    n_shards = F.least(F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)), F.lit(MOST_SHARDS)).cast("long")
    sources = written(sources.select("source", "source_no", "source_size", "target", words.cast("long").alias("words"), run.alias("run"), n_shards.alias("n_shards")), "mix-sources")

    rows = units.join(sources, units["source"].eqNullSafe(sources["source"])).drop(units["source"])
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed), "_d", "_t")).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_d", "_t"), F.col("n_shards")))
    shards = rows.groupBy("source_no", "shard").agg(F.sum(F.col("n") * F.col("size")).alias("shard_size"), F.first("words").alias("words"), F.first("run").alias("run"))
    quota = F.least(F.col("quota"), F.col("shard_size") * passes)
    shards = sainte_lague(shards, ["source_no"], "shard", "shard_size", "words").withColumn("rounds", F.when(F.col("shard_size") > 0, F.floor(quota / F.col("shard_size"))).otherwise(0).cast("long"))
    shards = shards.withColumn("extra", quota - F.col("rounds") * F.col("shard_size")).select("source_no", "shard", "shard_size", "run", "rounds", "extra")
    # a shard's runs in seeded order: the one that fills the quota is cut, and those before it are drawn whole
    drawn = shards.filter("extra > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("shard_size") - 1) / F.col("run")))))
    mark = lambda block: F.xxhash64(F.lit(seed + 2), "source_no", "shard", block)
    drawn = drawn.withColumn("length", F.least(F.col("run"), F.col("shard_size") - F.col("block") * F.col("run"))).withColumn("mark", mark(F.col("block")))
    drawn = drawn.withColumn("full", F.sum("length").over(Window.partitionBy("source_no", "shard").orderBy("mark", "block").rowsBetween(Window.unboundedPreceding, 0)))
    last = drawn.filter((F.col("full") >= F.col("extra")) & (F.col("full") - F.col("length") < F.col("extra"))).select("source_no", "shard", F.struct("mark", "block").alias("last"), (F.col("length") - F.col("full") + F.col("extra")).alias("kept"))
    quotas = written(shards.select("source_no", "shard", "rounds").join(last, ["source_no", "shard"], "left"), "mix-quotas")

    # a shard's units in seeded order are one line of words; each unit reads from the last run which of its own are drawn
    order = Window.partitionBy("source_no", "shard").orderBy("draw", "_d", "_t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.col("n") * F.col("size")).over(order)).withColumn("start", F.col("stop") - F.col("n") * F.col("size")).join(quotas, ["source_no", "shard"])
    within = lambda place: F.floor((F.least(F.greatest(place, F.col("start")), F.col("stop")) - F.col("start")) / F.col("n"))

    def piece(block: Column) -> Column:
        here = F.struct(mark(block).alias("mark"), block.alias("block"))
        length = F.when(here < F.col("last"), F.col("run")).when(here == F.col("last"), F.col("kept")).otherwise(F.lit(0).cast("long"))
        return F.struct(within(block * F.col("run")).alias("start"), within(block * F.col("run") + length).alias("stop"))

    pieces = F.filter(F.transform(F.sequence(F.floor(F.col("start") / F.col("run")), F.floor((F.col("stop") - 1) / F.col("run"))), piece), lambda r: r["start"] < r["stop"])
    ranges = F.when(F.col("last").isNotNull() & (F.col("size") > 0), pieces).otherwise(F.array().cast(RANGES))
    return rows.select("source", "_d", "_t", "source_size", "target", "rounds", ranges.alias("ranges"))


def _drawn_words(ranges: str) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])


def _base(docs: DataFrame) -> DataFrame:
    base = with_identity(docs.select("doc_id", "text", "source"))
    return written(base.select("doc_id", "_d", "_t", "source", n_words(F.col("text")).alias("size")), "mix-sizes")


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, passes: int = PASSES, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken and ranges, the word ranges (start, stop) that are drawn beside its whole copies, in order.

    size counts the words of a text (null or blank: 0). taken is what the mix takes of it, `passes` times its size at most. A source at
    its cap is taken whole; any other meets its target within half a block of at most a FEWEST_BLOCKSth of the smallest target, and
    rounding to words. Rows that agree in doc_id, text and source are taken alike, which rounds by their number. A null source is a
    source of its own, the last one. An empty table gives no rows, and a corpus without words has targets of 0. Other columns are not
    read. The same table, seed and parameters give the same mix.
    """
    base = _base(docs)
    plan = _plan(base, weights, budget, passes, seed, block_words, shard_words).withColumnRenamed("source", "_source")
    rows = base.join(plan.withColumnsRenamed({"_d": "_e", "_t": "_u"}), (F.col("_d") == F.col("_e")) & (F.col("_t") == F.col("_u")) & F.col("source").eqNullSafe(F.col("_source")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + _drawn_words("ranges")).alias("taken"), "ranges")


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, passes: int = PASSES, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs as the mix takes them (see mix_sources): a row for each whole copy, and one with the drawn words of a document that is taken in part.

    Columns are those of docs. A part runs from its first to its last drawn word as the text has them, and drawn ranges that don't touch
    are parted by a line feed; n_chars, where there is one, counts the new text. Texts without words are not taken.
    """
    base = _base(docs).filter("size > 0")
    plan = _plan(base, weights, budget, passes, seed, block_words, shard_words)
    plan = plan.join(base.select("_d", "_t", "size").distinct(), ["_d", "_t"]).filter("rounds > 0 OR size(ranges) > 0").select(F.col("source").alias("_source"), F.col("_d").alias("_e"), F.col("_t").alias("_u"), "size", "rounds", "ranges")
    # a document all of whose runs are drawn once more is a whole copy
    more = _drawn_words("ranges")
    whole = (F.col("rounds") + F.when(more == F.col("size"), 1).otherwise(0)).cast("int")
    takes = F.concat(F.array_repeat(F.array().cast(RANGES), whole), F.when((more > 0) & (more < F.col("size")), F.array(F.col("ranges"))).otherwise(F.array().cast(f"array<{RANGES}>")))
    rows = packed(docs, docs["source"].alias("_own_source"), docs["text"].alias("_text"))
    rows = rows.join(plan, (F.col("_d") == F.col("_e")) & (F.col("_t") == F.col("_u")) & F.col("_own_source").eqNullSafe(F.col("_source"))).withColumn("_take", F.explode(takes))

    def part(pieces: Column) -> Column:
        # words, each with the white space after it; neighbouring blocks stay as they were
        cut = lambda r: F.array_join(F.slice(pieces, (r["start"] + 1).cast("int"), (r["stop"] - r["start"]).cast("int")), "")
        touches = lambda i: (i > 0) & (F.get(F.col("_take"), i - 1)["stop"] == F.get(F.col("_take"), i)["start"])
        tail = lambda t: F.regexp_replace(t, WHITE_RUN + "\\z", "")
        return F.array_join(F.transform("_take", lambda r, i: F.concat(F.when((i == 0) | touches(i), F.lit("")).otherwise(F.lit("\n")), F.when(touches(i + 1), cut(r)).otherwise(tail(cut(r))))), "")

    pieces = F.regexp_extract_all("_text", F.lit("[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"), 0)
    new = {"text": F.when(F.size("_take") == 0, F.col("_text")).otherwise(let(pieces, part))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(new["text"]).cast(docs.schema["n_chars"].dataType)
    return unpacked(rows, docs, new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("ranges")

