"""2. Substring dedup: De Bruijn compaction over word k-mers.

Edges are runs of k words. They are never sorted singly: consecutive edges that
share their minimizer (the least hash of a shorter run in them) form a path, one
row a path. Equal edges share their minimizer, so only paths with a repeated one
matter; joins find them. A path whose words, read at its source coordinates,
occur again whole is repeated as a whole. Where every copy of one path runs on
into every copy of another, nothing branches between them, and joins glue them:
chains of such paths become one maximal path, a row each place it stands.
Where paths of one minimizer differ, as at the ends of a shared passage, one
occurrence of each distinct path is opened into its edges, and edges found in
two paths are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_join, table, with_identity, written
from .words import U, Words, mix, pieces, texts

SPAN = 35
#: Words of the run whose least hash is an edge's minimizer.
RUN = 8
_PLACE = (1 << 28) - 1


def paths(w: Words, span: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word counted within the text, number of edges, minimizer) of each path."""
    run = min(run, span)
    width = span - run + 1  # runs in an edge
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, U),)
    r = w.runs(run, 3)
    if len(w.hash) < span:
        return none
    # ties between runs go to the first; places fill the low bits
    key = (r & ~U(_PLACE)) | np.arange(len(r), dtype=U)
    size, low = 1, key
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        rest = width - size
        low = np.minimum(low[: len(low) - rest], low[rest:])
    text = np.repeat(np.arange(len(w.count)), np.maximum(w.count - span + 1, 0))
    if not len(text):
        return none
    nth = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(np.maximum(w.count - span + 1, 0))])[:-1], np.maximum(w.count - span + 1, 0))
    at = (low[w.first[text] + nth] & U(_PLACE)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    return text[head], nth[head], np.diff(np.concatenate([head, [len(at)]])), mix(r[at[head]], 5)


def _ids(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    take = pa.array(rows)
    return [batch.column("_d").take(take), batch.column("_t").take(take)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _find_paths(span: int, run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            text, start, n, m = paths(Words(*texts(batch.column("text"))), span, run)
            yield pa.RecordBatch.from_arrays([*_ids(batch, text), _signed(m), pa.array(start), pa.array(n)], ["_d", "_t", "m", "start", "n"])

    return go


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and digest of each text as it is."""
    for batch in pieces(batches, "text"):
        split = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_d"), batch.column("_t"), pa.array([len(s) for s in split], pa.int64()), pa.array([hashlib.sha256(b" ".join(s)).hexdigest() for s in split])], ["doc_id", "_d", "_t", "n_words", "sha"])


def _digests(span: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digest of each path's words, read at its source coordinates, and that of the path that follows at once."""
        for batch in pieces(batches, "text"):
            out: list[list] = [[] for _ in range(8)]
            follows: list[bool] = []
            for d, t, copies, text, spans in zip(*(batch.column(c).to_pylist() for c in ("_d", "_t", "copies", "text", "spans")), strict=True):
                words = text.encode().split()
                end = -1
                for s in spans:
                    digest = hashlib.blake2b(b" ".join(words[s["start"] : s["start"] + s["n"] + span - 1]), digest_size=16).digest()
                    for column, value in zip(out, (d, t, copies, s["m"], int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), s["start"], s["n"]), strict=True):
                        column.append(value)
                    follows.append(s["start"] == end)
                    end = s["start"] + s["n"]
            to = [[v if f else None for v, f in zip(column[1:], follows[1:], strict=True)] + [None] * bool(column) for column in (out[4], out[5])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*out, *to)], ["_d", "_t", "copies", "m", "g", "h", "start", "n", "to_g", "to_h"])

    return go


def _edges(span: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The edges of the opened paths, each by the digest of its words, read at their source coordinates, with the path's digest and the edge's place in it."""
        for batch in pieces(batches, "text"):
            out: list[list] = [[], [], [], []]
            digests, bits = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.encode().split()
                line = b" ".join(words)
                at = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
                for s in spans:
                    for bit in range(s["n"]):
                        i = s["start"] + bit
                        digests.append(hashlib.blake2b(line[at[i] : at[i + span] - 1], digest_size=16).digest())
                    bits.append(np.arange(s["n"], dtype=np.int32))
                    for column, value in zip(out, (s["m"], s["g"], s["h"], s["n"]), strict=True):
                        column.append(value)
            if not digests:
                continue
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            same = [pa.array(np.repeat(np.array(c, np.int64), out[3])) for c in out[:3]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), *same, pa.array(np.concatenate(bits))], ["a", "b", "m", "g", "h", "bit"])

    return go


def _cut(span: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts less the words that repeated edges cover."""
        for batch in pieces(batches, "text"):
            kept, gone = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.encode().split()
                step = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    mask = s["mask"]
                    if mask == -1:  # all its edges
                        step[s["start"]] += 1
                        step[s["start"] + s["n"] + span - 1] -= 1
                        continue
                    for i in range(s["n"]):
                        if mask >> i & 1:
                            step[s["start"] + i] += 1
                            step[s["start"] + i + span] -= 1
                covered = np.cumsum(step)[:-1] > 0
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~covered)]).decode())
                gone.append(int(covered.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("_d"), batch.column("_t"), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept])], ["_d", "_t", "n_removed", "kept", "sha"])

    return go


def glue(kinds: DataFrame) -> DataFrame:
    """Of kinds (a row a distinct path: m, g, h, c places, lo and hi: the least and greatest path that follows it at once, at `followed`
    places): those (m, g, h) between which and their follower nothing branches.

    That is so where one path follows at all places, and stands at no other place. At most one path of as many places as its
    follower can be like that, so candidates are counted before the join, and its keys are single on either side.
    """
    repeated = kinds.filter("c > 1")
    before = repeated.filter("followed = c AND lo = hi").groupBy(F.col("lo.g").alias("g"), F.col("lo.h").alias("h"), "c").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("m", "g", "h")).alias("path")).filter("k = 1")
    return before.join(repeated.select("g", "h", "c"), ["g", "h", "c"]).select("path.*")


def compacted(hits: DataFrame) -> DataFrame:
    """Repeated paths (_d, _t, start, n, mask, glued), with each chain of glued ones and the one after them as one maximal path: _d, _t, start, n, mask.

    A glued path's follower comes next wherever it stands, so that a document's rows show its chains whole, however long, without rounds of doubling.
    """
    place = Window.partitionBy("_d", "_t").orderBy("start")
    chain = F.sum("_new").over(place.rowsBetween(Window.unboundedPreceding, 0))
    chains = hits.withColumn("_new", F.when(F.lag("glued").over(place), 0).otherwise(1)).withColumn("chain", chain)
    return chains.groupBy("_d", "_t", "chain").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.max("mask").alias("mask")).drop("chain")


def repeated_paths(base: DataFrame, span: int = SPAN, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """For base (_d, _t, text): the maximal paths of repeated edges (_d, _t, start, n, mask), mask -1 for all edges, else bits of the repeated ones;
    and the texts that have any path whose minimizer is repeated (_d, _t, text). Repeated rows are one text in both, but its edges are repeated."""
    found = base.mapInArrow(_find_paths(span, run), "_d long, _t long, m long, start long, n long")
    # paths are found once more rather than written: that takes less than keeping all of them
    again = written(found.groupBy("m").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "substring-minimizers")
    # a text of repeated rows gives each place once a row
    near = hot_join(found, again, ["m"], "c").groupBy("_d", "_t").agg(F.collect_set(F.struct("start", "m", "n")).alias("spans"), F.count(F.lit(1)).alias("all"))
    near = near.select("_d", "_t", F.sort_array("spans").alias("spans"), (F.col("all") / F.size("spans")).cast("long").alias("copies"))
    some = written(base.join(near, ["_d", "_t"]).dropDuplicates(["_d", "_t"]), "substring-texts")
    rows = written(some.mapInArrow(_digests(span), "_d long, _t long, copies long, m long, g long, h long, start long, n long, to_g long, to_h long"), "substring-paths")
    to = F.when(F.col("to_g").isNotNull(), F.struct(F.col("to_g").alias("g"), F.col("to_h").alias("h")))
    kinds = rows.groupBy("m", "g", "h").agg(F.sum("copies").alias("c"), F.min(F.struct("_d", "_t", "start", "n")).alias("one"), F.min(to).alias("lo"), F.max(to).alias("hi"), F.sum(F.when(to.isNotNull(), F.col("copies"))).alias("followed"))
    kinds = written(kinds, "substring-kinds")
    branching = written(kinds.groupBy("m").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "substring-branching")
    opened = hot_join(kinds, branching, ["m"], "k").select("m", "g", "h", "one.*").groupBy("_d", "_t").agg(F.collect_list(F.struct("m", "g", "h", "start", "n")).alias("spans"))
    edges = written(some.select("_d", "_t", "text").join(opened, ["_d", "_t"]).mapInArrow(_edges(span), "a long, b long, m long, g long, h long, bit int"), "substring-edges")
    twice = written(edges.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "substring-twice")
    masks = hot_join(edges, twice, ["a", "b"], "c").groupBy("m", "g", "h").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    marked = kinds.select("m", "g", "h", "c").join(masks, ["m", "g", "h"], "left").withColumn("mask", F.when(F.col("c") > 1, F.lit(-1).cast("long")).otherwise(F.col("bits"))).filter("mask IS NOT NULL")
    marked = marked.join(glue(kinds).withColumn("glued", F.lit(True)), ["m", "g", "h"], "left").select("m", "g", "h", "c", "mask", F.coalesce("glued", F.lit(False)).alias("glued"))
    hits = hot_join(rows.drop("copies", "to_g", "to_h"), written(marked, "substring-marked"), ["m", "g", "h"], "c").select("_d", "_t", "start", "n", "mask", "glued")
    return compacted(hits), some.select("_d", "_t", "text")


def substring_dedup(docs: DataFrame, span: int = SPAN, run: int = RUN) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256, and kept (the kept words joined by one space; null where none goes).

    A word goes if a run of `span` words that covers it also starts anywhere else, in the same document included. Words are runs outside
    [\\x20\\x09-\\x0D], unchanged; runs are judged on the input. A null or blank text has no words. Rows that repeat doc_id and text
    repeat each other. An empty table gives no rows; other columns are not read.
    """
    base = with_identity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    whole = base.mapInArrow(_whole, "doc_id long, _d long, _t long, n_words long, sha string")
    hits, some = repeated_paths(base.select("_d", "_t", "text"), span, run)
    spans = hits.groupBy("_d", "_t").agg(F.collect_list(F.struct("start", "n", "mask")).alias("spans"))
    cut = some.join(spans, ["_d", "_t"]).mapInArrow(_cut(span), "_d long, _t long, n_removed long, kept string, sha string")
    cut = cut.withColumnRenamed("sha", "cut_sha")
    out = whole.join(cut, ["_d", "_t"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"), "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


SQL = r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), k AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 34)) AS i, w FROM t WHERE len(w) >= 35
), h AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS m FROM k
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM h) WHERE c > 1
), p AS (
  SELECT DISTINCT doc_id, i + unnest(generate_series(0, 34)) AS i FROM r
), u AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t
), o AS (
  SELECT u.doc_id, count(*) AS n_words, count(p.i) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY u.i) FILTER (p.i IS NULL), '') AS kept
  FROM u LEFT JOIN p ON u.doc_id = p.doc_id AND u.i = p.i GROUP BY u.doc_id
)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN o ON t.doc_id = o.doc_id
"""
