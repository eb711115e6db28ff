"""Column helpers, row identity and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"
_LEAST = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once. A plain column used inside a lambda would be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """array<string> of the maximal runs outside WHITE, unchanged; empty for null or blank text."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RUN))


def n_words(text: Column) -> Column:
    """Number of words, as `words` counts them."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, WHITE_RUN))).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; all else stays. Plain lower() serves where every character is one byte."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def with_identity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds _d (the id, null as the least long) and _t (a hash of the text). Rows that agree in both are one document to the operators, so repeated rows get the same decisions and never multiply in a join."""
    return docs.withColumns({"_d": F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)), "_t": F.xxhash64(F.coalesce(F.col(text_col), F.lit("\x00")))})


def packed(docs: DataFrame, *more: Column, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """_row (all columns of docs in one struct, whatever their names), the identity (_d, _t) and more columns, so that none of docs' own can clash."""
    text = docs["text"] if text is None else text
    identity = [F.coalesce(docs[id_col].cast("long"), F.lit(_LEAST)).alias("_d"), F.xxhash64(F.coalesce(text, F.lit("\x00"))).alias("_t")]
    return docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("_row"), *identity, *more)


def unpacked(rows: DataFrame, docs: DataFrame, new: dict[str, Column] | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """The columns of docs out of packed rows, some with new values; then more columns, in place of docs' own of that name."""
    new, more = new or {}, more or {}
    return rows.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns if c not in more], *[v.alias(k) for k, v in more.items()])


def hot_join(rows: DataFrame, keys: DataFrame, on: list[str], count: str, salts: int = 64) -> DataFrame:
    """rows joined with keys (one row a key, `count` of rows has it), the rows of hot keys dealt over `salts` tasks.

    A key is hot that has over a thousandth of all the keys' rows, so at most 1,000 are, and only those are broadcast. keys is
    read several times and should be written.
    """
    total = keys.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) > max(1000, total // 1000)
    hot = keys.filter(is_hot).select(*on, F.lit(salts).alias("_salts"))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*[c for c in rows.columns if c not in on]), F.lit(salts))).cast("int")).drop("_salts")
    each = keys.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(each, [*on, "_salt"]).drop("_salt")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a new local one; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder, for small tables of iterations."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
