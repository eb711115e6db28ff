"""5. N-gram Jaccard join: a MinHash LSH forest with exact verification.

Each tree labels a text with a sequence of MinHash values, packed so that sorted
labels are the tree's prefix trie. A text's search starts at its whole labels.
As long as a pair at the threshold would meet with less than the target recall,
the text shortens its prefix by a value, each time in the tree where that adds
the fewest texts. Texts that meet form candidate groups; in blocks of a group,
read one after another, pairs are verified by their exact sets of word runs, and
only counts and a spanning forest leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_join, packed, table, unpacked, with_identity, written
from .words import U, Words, mix, pieces, texts

SHINGLE = 5
THRESHOLD = (4, 5)
RECALL = 0.999
TREES, DEPTH, VALUE_BITS = 16, 5, 12
#: Texts a block of a group at least; a group is cut into MOST_BLOCKS at most until blocks would pass LARGEST_BLOCK texts or BLOCK_WORDS words.
BLOCK, MOST_BLOCKS, LARGEST_BLOCK, BLOCK_WORDS = 64, 40, 4096, 2_000_000


def search_depth(threshold: float, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> tuple[int, int]:
    """(depth, k): a pair at the threshold meets with the target recall by prefixes of this depth, of one value less in k trees; whole labels if they do."""
    missed = lambda k: (1 - threshold**depth) ** (trees - k) * (1 - threshold ** (depth - 1)) ** k
    while depth > 1:
        for k in range(trees):
            if missed(k) <= 1 - recall:
                return depth, k
        depth -= 1
    return 1, 0


def forest_edges(kinds: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Edges (u, v) that connect the texts (node, labels) that meet in the forest: a star for each node of a trie that some search reaches."""
    depth, k = search_depth(threshold, recall)
    cut = lambda d: F.shiftright("label", VALUE_BITS * (DEPTH - d))
    leaves = kinds.select("node", F.posexplode("labels").alias("tree", "label")).select("node", "tree", cut(depth).alias("deep"), cut(max(1, depth - 1)).alias("short"))
    # a trie's nodes that hold one text alone lead nowhere
    above = written(leaves.groupBy("tree", "short").agg(F.count(F.lit(1)).alias("n_short")).filter("n_short > 1"), "forest-short")
    met = written(hot_join(leaves, above, ["tree", "short"], "n_short"), "forest-met")
    deep = written(met.groupBy("tree", "deep").agg(F.count(F.lit(1)).alias("n_deep"), F.min("node").alias("centre")), "forest-deep")
    met = hot_join(met, deep, ["tree", "deep"], "n_deep")
    # trees where a text is alone are shortened for nothing, and count first
    mine = Window.partitionBy("node")
    to_shorten = F.lit(k - TREES) + F.count(F.lit(1)).over(mine)
    nth = F.row_number().over(mine.orderBy(F.col("n_short") - F.col("n_deep"), "tree"))
    met = written(met.withColumn("shortens", nth <= to_shorten), "forest-searches")
    stars = met.filter("node <> centre").select(F.col("centre").alias("u"), F.col("node").alias("v"))
    wide = met.groupBy("tree", "short").agg(F.max("shortens").alias("any"), F.min("node").alias("u")).filter("any").select("tree", "short", "u")
    wide = met.select("tree", "short", F.col("centre").alias("v")).distinct().join(wide, ["tree", "short"]).filter("u <> v").select("u", "v")
    return stars.unionByName(wide).distinct()


def _runs(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' word runs, and each text's first (one more at the end). A shorter text with words is one run."""
    r = w.runs(size, 21)
    number = np.where(w.count >= size, w.count - size + 1, np.minimum(w.count, 1))
    first = np.concatenate([[0], np.cumsum(number)])
    owner = np.repeat(np.arange(len(number)), number)
    at = w.first[owner] + np.arange(len(owner)) - first[owner]
    short = w.count[owner] < size
    out = np.empty(len(owner), U)
    out[~short] = r[at[~short]]
    for i in np.flatnonzero(short):
        h = w.hash[at[i] : at[i] + w.count[owner[i]]]
        out[i] = mix((mix(h, 22) * np.arange(1, 2 * len(h), 2, dtype=U)).sum(keepdims=True), 23 + len(h))[0]
    return out, first


def _sequence(w: Words, seed: int) -> np.ndarray:
    """A hash of each text's words in order."""
    from .words import _powers

    up, down = _powers(len(w.hash) + 1)
    sums = np.zeros(len(w.hash) + 1, U)
    np.cumsum(mix(w.hash, seed) * up[: len(w.hash)], dtype=U, out=sums[1:])
    return mix((sums[w.first[1:]] - sums[w.first[:-1]]) * down[w.first[:-1]] + w.count.astype(U), seed)


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    odd = mix(np.arange(TREES * DEPTH, dtype=U), 31) | U(1)
    for batch in pieces(batches, "text"):
        w = Words(*texts(batch.column("text")))
        runs, first = _runs(w, SHINGLE)
        some = np.flatnonzero(np.diff(first))
        labels = np.zeros((batch.num_rows, TREES), U)
        for k in range(TREES * DEPTH if len(some) else 0):
            least = np.minimum.reduceat(runs * odd[k], first[:-1][some])
            labels[some, k // DEPTH] |= (mix(least, k) >> U(64 - VALUE_BITS)) << U(VALUE_BITS * (DEPTH - 1 - k % DEPTH))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, TREES * (batch.num_rows + 1), TREES), pa.int32()), pa.array(labels.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("_d"), batch.column("_t"), *(pa.array(_sequence(w, s).view(np.int64)) for s in (41, 42)), pa.array(w.count), lists], ["_d", "_t", "a", "b", "n", "labels"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected edges (u, v), roots the same for nodes that edges connect.

    Each round moves every node to its least neighbour and contracts the edges, which at least thins them out geometrically as node numbers
    are hashes; an edge's two ends are looked up by joins, and each round is written.
    """
    edges = written(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "component-edges")
    roots = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moves = written(ends.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("to")), "component-moves")
        if roots is None:
            roots = moves.select("node", F.col("to").alias("root"))
        else:
            onward = moves.select(F.col("node").alias("root"), "to")
            roots = written(roots.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "component-roots")
        at_u, at_v = moves.select(F.col("node").alias("u"), F.col("to").alias("x")), moves.select(F.col("node").alias("v"), F.col("to").alias("y"))
        moved = edges.join(at_u, "u").join(at_v, "v").filter("x <> y")
        edges = written(moved.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "component-edges")
    return roots if roots is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Boolean matrix: whose Jaccard similarity reaches the threshold. Counts are exact in single precision below 2**24."""
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    rows, column = rows[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    columns = int(column[-1]) + 1 if len(column) else 0
    step = max(1, min(columns, max(256, 8_000_000 // len(sets))))
    for low in range(0, columns, step):
        a, b = np.searchsorted(column, (low, low + step))
        m = np.zeros((len(sets), step), np.float32)
        m[rows[a:b], column[a:b] - low] = 1
        common += m[left] @ m[right].T
    p, q = threshold
    both = sizes[left][:, None] + sizes[right][None, :]
    # common / (both - common) >= p / q
    return (p + q) * common.astype(np.int64) >= p * both


def _verified(group: pa.Table, threshold: tuple[int, int]) -> pa.RecordBatch | None:
    """(node, links, to) of one pair of blocks of a group: what each text is linked to, and the least text that links lead to."""
    node, copies, part = (group.column(c).to_numpy() for c in ("node", "copies", "part"))
    i, j = (group.column(c)[0].as_py() for c in ("i", "j"))
    some = np.unique(node, return_index=True)[1]  # repeated rows of one text
    left, right = (np.flatnonzero(part[some] == x) for x in (i, j))
    if len(some) < 2 or not len(left) or not len(right):
        return None
    sets = []
    for piece in pieces(iter(group.select(["text"]).take(pa.array(some)).combine_chunks().to_batches()), "text"):
        runs, first = _runs(Words(*texts(piece.column("text"))), SHINGLE)
        sets += [np.unique(runs[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    linked = _linked(sets, left, right, threshold)
    if i == j:
        linked &= ~np.eye(len(some), dtype=bool)
    links = np.zeros(len(some), np.int64)
    links[left] += linked @ copies[some][right]
    if i != j:
        links[right] += linked.T @ copies[some][left]
    # least label of what a text is linked to, until nothing changes; texts are in order here
    label = np.arange(len(some))
    while True:
        new = label.copy()
        for a, b, m in ((left, right, linked), (right, left, linked.T)):
            new[a] = np.minimum(new[a], np.where(m, label[b][None, :], len(some)).min(1))
        if (new == label).all():
            break
        label = new
    return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links), pa.array(node[some][label])], ["node", "links", "to"])


def _verify(threshold: tuple[int, int]):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (root, i, j); those of one pair of blocks are held at a time."""
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("root", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[:, a])
                if key != now and held:
                    out = _verified(pa.Table.from_batches(held).combine_chunks(), threshold)
                    held = []
                    if out is not None:
                        yield out
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            out = _verified(pa.Table.from_batches(held).combine_chunks(), threshold)
            if out is not None:
                yield out

    return go


def _groups(base: DataFrame, threshold: tuple[int, int], recall: float) -> tuple[DataFrame, DataFrame]:
    """Of base (_d, _t, text): (_d, _t, node) of all documents, and (node, copies, links, root, _least) of all distinct word sequences."""
    marked = written(base.mapInArrow(_label, "_d long, _t long, a long, b long, n long, labels array<long>"), "join-labels")
    kinds = written(marked.groupBy("a", "b", "n", "labels").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("_d", "_t")).alias("one")).select(F.col("a").alias("node"), "n", "labels", "copies", "one"), "join-kinds")
    near = components(forest_edges(kinds.filter("n > 0").select("node", "labels"), threshold[0] / threshold[1], recall))

    members = written(kinds.select("node", "n", "copies", "one").join(near, "node"), "join-members")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("words"))
    blocks = F.greatest(F.lit(1), F.least(F.ceil(F.col("m") / BLOCK), F.greatest(F.lit(MOST_BLOCKS), F.ceil(F.col("m") / LARGEST_BLOCK))), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")
    members = members.join(sizes.select("root", blocks.alias("blocks")), "root").select("one._d", "one._t", "node", "root", "copies", "blocks")
    # each pair of blocks of a group is read by itself
    # one plan at every size: small members would be broadcast, larger ones not
    rows = base.join(members.hint("merge"), ["_d", "_t"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", "root", "copies", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "text")
    checked = written(rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_verify(threshold), "node long, links long, to long"), "join-checked")

    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    final = components(checked.filter("to <> node").select(F.col("to").alias("u"), F.col("node").alias("v")))
    kinds = kinds.join(links, "node", "left").join(final, "node", "left").select("node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"), "one")
    least = kinds.groupBy("root").agg(F.min("one").alias("_least"))
    return marked.select("_d", "_t", F.col("a").alias("node")), written(kinds.join(least, "root"), "join-classes")


def jaccard_join(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row per document: doc_id, class_id, n_links.

    Two documents are linked if their sets of runs of five words have a Jaccard similarity of at least `threshold`; a shorter text with
    words is one run. n_links counts a document's links to other documents, equal ones included. class_id is the least doc_id
    of those that links connect. Texts without words, null ones too, are linked to each other only. A null doc_id comes first and
    gives a null class_id. Rows that repeat doc_id and text count as copies. An empty table gives no rows.
    """
    base = with_identity(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("_d", "_t", "text")
    rows, kinds = _groups(base, threshold, recall)
    out = rows.join(kinds.select("node", "copies", "links", "_least"), "node")
    real = lambda c: F.when(c != F.lit(-(1 << 63)), c)
    return out.select(real(F.col("_d")).alias("doc_id"), real(F.col("_least._d")).alias("class_id"), (F.col("copies") - 1 + F.col("links")).alias("n_links"))


def one_of_each(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs less all but the document of the least doc_id of each class (see jaccard_join). Rows that repeat both its doc_id and text stay too."""
    rows = packed(docs, F.coalesce(docs["text"], F.lit("")).alias("text"), text=F.coalesce(docs["text"], F.lit("")))
    _, kinds = _groups(rows.select("_d", "_t", "text"), threshold, recall)
    stay = kinds.select("_least._d", "_least._t").distinct()
    return unpacked(rows.join(stay, ["_d", "_t"], "left_semi"), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
