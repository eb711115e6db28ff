"""4. Toxicity: a bidirectional gated recurrent network with attention pooling.

A word's input joins a learnt embedding of the word with the mean of learnt
embeddings of its character runs, both by hashed buckets. Overlapping windows of
words go through a GRU in either direction, attention pools the states, and a
text scores as its most toxic window. All weights and embeddings are trained in
numpy, by back propagation, on a bounded sample of labelled rows; nothing but
the network judges a text.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import Words, mix, pieces, texts

#: At most so many labelled documents of each class are learnt from.
MOST_PER_CLASS = 1500
#: Words of a window, and words from one window's start to the next: a word is read in WINDOW / STRIDE windows, and words less than WINDOW - STRIDE apart in a common one.
WINDOW, STRIDE = 32, 8
LAP = WINDOW // STRIDE
#: So many windows go through the network at once.
CHUNK = 2048
WORD_BITS, CHAR_BITS = 16, 14
#: Characters of a run; a word has a border on either side.
RUNS = (4,)
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 16, 12
STEPS, DOCS_A_STEP = 320, 32
#: Windows drawn of a toxic document in a step; learning rates of the network and, times as much, of embeddings.
DRAWS, RATE, EMBEDDINGS_FASTER = 3, 0.003, 300
#: Share of the words that are left out of a training step, and decay of embeddings towards 0, where a word not learnt from stands; else a small sample is learnt by heart.
DROPPED, DECAY = 0.2, 2e-3
#: One in so many documents of the sample is kept from training, to set the cut.
FOLDS = 5
U = np.uint64
F4 = np.float32


class Inputs:
    """What a batch's distinct words are made of: buckets of the word and of its character runs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        # words are runs of letters here, A-Z lower-cased: all but ASCII letters and bytes of other characters part them
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        low = np.where((low >= 97) & (low <= 122) | (low >= 128), low, 32).astype(np.uint8)
        w = Words(low, offsets)
        self.first, self.count = w.first, w.count
        distinct, at, self.of = np.unique(w.hash, return_index=True, return_inverse=True)
        self.distinct = distinct
        start, end = w.start[at], w.end[at]
        self.word = (distinct >> U(64 - WORD_BITS)).astype(np.int64)
        # the distinct words' bytes side by side, each between two borders
        size = end - start + 2
        begin = np.concatenate([[0], np.cumsum(size)])
        flat = np.ones(begin[-1], np.uint8)
        total = int((end - start).sum())
        source = np.repeat(start - np.concatenate([[0], np.cumsum(end - start)])[:-1], end - start) + np.arange(total)
        target = np.repeat(begin[:-1] + 1 - np.concatenate([[0], np.cumsum(end - start)])[:-1], end - start) + np.arange(total)
        flat[target] = low[source]
        owner = np.repeat(np.arange(len(size)), size)
        runs, owners = [], []
        for n in RUNS:
            k = len(flat) - n + 1
            if k <= 0:
                continue
            h = np.zeros(k, U)
            for j in range(n):
                h = h * U(257) + flat[j : j + k]
            inside = owner[:k] == owner[n - 1 :]
            runs.append((mix(h[inside], n) >> U(64 - CHAR_BITS)).astype(np.int64))
            owners.append(owner[:k][inside])
        run, own = (np.concatenate(runs), np.concatenate(owners)) if runs else (np.empty(0, np.int64), np.empty(0, np.int64))
        # words shorter than a run have one of their own
        bare = np.setdiff1d(np.arange(len(size)), own)
        run, own = np.concatenate([run, (mix(distinct[bare], 9) >> U(64 - CHAR_BITS)).astype(np.int64)]), np.concatenate([own, bare])
        order = np.argsort(own, kind="stable")
        self.run, own = run[order], own[order]
        self.run_first = np.searchsorted(own, np.arange(len(size)))
        self.run_count = np.diff(np.concatenate([self.run_first, [len(own)]]))

    @classmethod
    def of_texts(cls, values: list[str]) -> Inputs:
        """The inputs of many texts, read a few at a time, which takes far less memory than all at once."""
        batch = pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["text"])
        parts = [cls(*texts(piece.column("text"))) for piece in pieces(iter([batch]), "text")]
        if not parts:
            return cls(*_bytes([]))
        self = cls.__new__(cls)
        self.distinct, at, number = np.unique(np.concatenate([p.distinct for p in parts]), return_index=True, return_inverse=True)
        before = np.cumsum([0, *(len(p.distinct) for p in parts)])
        self.of = np.concatenate([number[b + p.of] for p, b in zip(parts, before)])
        words_before = np.cumsum([0, *(p.first[-1] for p in parts)])
        self.first = np.concatenate([*(p.first[:-1] + b for p, b in zip(parts, words_before)), words_before[-1:]])
        self.count = np.concatenate([p.count for p in parts])
        # the runs of all parts' words, then those of each word's first place
        runs_before = np.cumsum([0, *(len(p.run) for p in parts)])
        self.run, self.run_first, self.run_count = np.concatenate([p.run for p in parts]), np.concatenate([p.run_first + b for p, b in zip(parts, runs_before)]), np.concatenate([p.run_count for p in parts])
        self.word, self.run = np.concatenate([p.word for p in parts])[at], self.run[self.runs_of(at)]
        self.run_count = self.run_count[at]
        self.run_first = np.cumsum(self.run_count) - self.run_count
        return self

    def vectors(self, net: dict, some: np.ndarray | None = None) -> np.ndarray:
        """A row for each of some distinct words (all), and one of zeros for what lies beyond a text's end."""
        word, size, run = (self.word, self.run_count, self.run) if some is None else (self.word[some], self.run_count[some], self.run[self.runs_of(some)])
        out = np.zeros((len(word) + 1, WORD_DIM + CHAR_DIM), F4)
        if len(word):
            out[:-1, :WORD_DIM] = net["word"][word]
            out[:-1, WORD_DIM:] = np.add.reduceat(net["char"][run], np.cumsum(size) - size, axis=0) / size[:, None].astype(F4)
        return out

    def runs_of(self, some: np.ndarray) -> np.ndarray:
        """Places in `run` of some words' runs, word by word."""
        size = self.run_count[some]
        return np.repeat(self.run_first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def laid_out(self, docs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of docs (all) in steps of STRIDE: (numbers of distinct words (step, STRIDE), the step each window starts with, its text's place in docs).

        A text's windows start at every STRIDE-th word until its end is covered; each text is filled up beyond its end.
        """
        docs = np.arange(len(self.count)) if docs is None else docs
        count = self.count[docs]
        number = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
        steps = np.where(count > 0, number + LAP - 1, 0)
        base = np.concatenate([[0], np.cumsum(steps)])
        out = np.full(base[-1] * STRIDE, len(self.word), np.int64)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(base[:-1] * STRIDE, count) + nth] = self.of[np.repeat(self.first[:-1][docs], count) + nth]
        owner = np.repeat(np.arange(len(docs)), number)
        start = np.repeat(base[:-1], number) + np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        return out.reshape(-1, STRIDE), start, owner


def _squash(x: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """x / (1 + |x|), in place: the network's bounded function, as it takes a tenth of a hyperbolic tangent's time. A gate is (1 + it) / 2."""
    room = np.abs(x, out=room)
    room += F4(1)
    x /= room
    return x


def _run_logits(net: dict, projected: list[np.ndarray], numbers: np.ndarray) -> np.ndarray:
    """Logits of the windows from each step of a run on, LAP - 1 less than it has steps: a step of the network reads its words side by side."""
    n = len(numbers) - LAP + 1
    states = np.empty((2, WINDOW, HIDDEN, n), F4)
    flat = numbers.T.ravel()
    hu, zr, m, room = np.empty((3 * HIDDEN, n), F4), np.empty((2 * HIDDEN, n), F4), np.empty((HIDDEN, n), F4), np.empty((2 * HIDDEN, n), F4)
    for k, way in enumerate("fb"):
        u = np.ascontiguousarray(net["u" + way].T)
        inputs = np.ascontiguousarray(projected[k][flat].T).reshape(3 * HIDDEN, STRIDE, len(numbers))
        h = np.zeros((HIDDEN, n), F4)
        for t in range(WINDOW) if way == "f" else reversed(range(WINDOW)):
            now = inputs[:, t % STRIDE, t // STRIDE : t // STRIDE + n]
            np.matmul(u, h, out=hu)
            np.add(now[: 2 * HIDDEN], hu[: 2 * HIDDEN], out=zr)
            _squash(zr, room)
            zr *= F4(0.5)
            zr += F4(0.5)
            np.multiply(zr[HIDDEN:], hu[2 * HIDDEN :], out=m)
            m += now[2 * HIDDEN :]
            _squash(m, room[:HIDDEN])
            new = states[k, t]
            np.subtract(h, m, out=new)
            new *= zr[:HIDDEN]
            new += m
            h = new
    e, value = np.empty((WINDOW, n), F4), np.empty((WINDOW, n), F4)
    heads, ca = np.ascontiguousarray(np.concatenate([net["wa"], net["wo"][:, None]], 1).T), net["ca"][:, None]
    for t in range(WINDOW):
        a = heads[:, :HIDDEN] @ states[0, t]
        a += heads[:, HIDDEN:] @ states[1, t]
        value[t] = a[-1]
        a = a[:-1]
        a += ca
        e[t] = net["va"] @ _squash(a)
    e -= e.max(0)
    np.exp(e, out=e)
    return (e * value).sum(0) / e.sum(0) + net["co"][0]


def _logits(net: dict, x: np.ndarray, numbers: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Logits of the windows that start with the given steps, in order; x: vectors of distinct words."""
    projected = [x @ net["w" + way] + net["c" + way] for way in "fb"]
    out = np.empty(len(start), F4)
    for k in range(0, len(numbers) - LAP + 1, CHUNK):
        a, b = np.searchsorted(start, (k, k + CHUNK))
        if a < b:
            out[a:b] = _run_logits(net, projected, numbers[k : k + CHUNK + LAP - 1])[start[a:b] - k]
    return out


def _gru(inputs: np.ndarray, u: np.ndarray, keep: list) -> np.ndarray:
    """States (time, window, HIDDEN) from projected inputs (time, window, 3 HIDDEN); keep takes what going back needs."""
    h = np.zeros((inputs.shape[1], HIDDEN), F4)
    out = np.empty((*inputs.shape[:2], HIDDEN), F4)
    for t, x in enumerate(inputs):
        hu = h @ u
        zr = 0.5 * _squash(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]) + 0.5
        z, r, hn = zr[:, :HIDDEN], zr[:, HIDDEN:], hu[:, 2 * HIDDEN :]
        n = _squash(x[:, 2 * HIDDEN :] + r * hn)
        keep.append((h, z, r, n, hn))
        h = out[t] = n + z * (h - n)
    return out


def _gru_back(dout: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u."""
    dx = np.empty((*dout.shape[:2], 3 * HIDDEN), F4)
    du, dh = np.zeros_like(u), np.zeros(dout.shape[1:], F4)
    for t in reversed(range(len(dout))):
        h, z, r, n, hn = kept[t]
        g = dh + dout[t]
        dn = g * (1 - z) * (1 - np.abs(n)) ** 2
        dz = g * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dn * hn * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        dhu = np.concatenate([dz, dr, dn * r], 1)
        dx[t] = np.concatenate([dz, dr, dn], 1)
        du += h.T @ dhu
        dh = g * z + dhu @ u.T
    return dx, du


def _forward(net: dict, x: np.ndarray, keep: dict) -> np.ndarray:
    """Logits of windows from their words' vectors (time, window, dim), plainly; keep takes what `_backward` needs."""
    kept: tuple = ([], [])
    f, b = (_gru((x @ net["w" + way] + net["c" + way])[::back], net["u" + way], kept[k])[::back] for k, (way, back) in enumerate((("f", 1), ("b", -1))))
    h = np.concatenate([f, b], 2)
    a = _squash(h @ net["wa"] + net["ca"])
    e = a @ net["va"]
    e = np.exp(e - e.max(0))
    e /= e.sum(0)
    pooled = np.einsum("tw,twh->wh", e, h)
    keep.update(x=x, kept=kept, h=h, a=a, e=e, pooled=pooled)
    return pooled @ net["wo"] + net["co"][0]


def _backward(net: dict, d: np.ndarray, keep: dict) -> tuple[dict, np.ndarray]:
    """Gradients of the network and of the words' vectors, from those of the logits."""
    x, h, a, e = keep["x"], keep["h"], keep["a"], keep["e"]
    g = {"wo": keep["pooled"].T @ d, "co": d.sum(keepdims=True)}
    dp = d[:, None] * net["wo"]
    de = np.einsum("twh,wh->tw", h, dp)
    de = e * (de - (e * de).sum(0))
    da = de[..., None] * net["va"] * (1 - np.abs(a)) ** 2
    g["va"] = np.einsum("twk,tw->k", a, de)
    g["wa"], g["ca"] = np.einsum("twh,twk->hk", h, da), da.sum((0, 1))
    dh = e[..., None] * dp + da @ net["wa"].T
    dx = np.zeros_like(x)
    for k, (way, back) in enumerate((("f", 1), ("b", -1))):
        dproj, g["u" + way] = _gru_back(dh[::back, :, k * HIDDEN : (k + 1) * HIDDEN], net["u" + way], keep["kept"][k])
        dproj = dproj[::back]
        g["w" + way], g["c" + way] = np.einsum("twi,twj->ij", x, dproj), dproj.sum((0, 1))
        dx += dproj @ net["w" + way].T
    return g, dx


def new_net(seed: int = 4) -> dict:
    """An untrained network. Embeddings start at 0, which is where a word that training never meets stays."""
    rng = np.random.default_rng(seed)
    dim = WORD_DIM + CHAR_DIM
    net = {"word": np.zeros((1 << WORD_BITS, WORD_DIM)), "char": np.zeros((1 << CHAR_BITS, CHAR_DIM))}
    for way in "fb":
        net["w" + way] = rng.normal(0, 0.5, (dim, 3 * HIDDEN))
        net["u" + way] = np.concatenate([np.linalg.qr(rng.normal(size=(HIDDEN, HIDDEN)))[0] for _ in range(3)], 1)
        net["c" + way] = np.zeros(3 * HIDDEN)
    net |= {"wa": rng.normal(0, 0.4, (2 * HIDDEN, ATTENTION)), "ca": np.zeros(ATTENTION), "va": rng.normal(0, 0.4, ATTENTION), "wo": rng.normal(0, 0.4, 2 * HIDDEN), "co": np.full(1, -1.0)}
    return {k: v.astype(F4) for k, v in net.items()}


def train(sample: list[tuple[str, int]], seed: int = 4, steps: int | None = None) -> dict:
    """The network, from (text, label) pairs. One class only gives a network that scores all texts as that class's share."""
    sample = [(t or "", int(y)) for t, y in sample]
    steps = STEPS if steps is None else steps
    rng, net = np.random.default_rng(seed), new_net(seed)
    y = np.array([b for _, b in sample], np.int64)
    extras = {"base": np.array([(y.sum() + 0.5) / (len(y) + 1.0)], F4), "shift": np.zeros(1, F4)}
    inputs = Inputs.of_texts([t for t, _ in sample])
    some = [np.flatnonzero((y == b) & (inputs.count > 0)) for b in (0, 1)]
    if not len(some[0]) or not len(some[1]):
        return net | extras | {"flat": np.array([True])}
    # those that set the cut; a class of few documents has none to spare
    aside = np.concatenate([c[::FOLDS] if len(c) >= 4 * FOLDS else c for c in some])
    classes = [np.setdiff1d(c, aside) if len(c) >= 4 * FOLDS else c for c in some]
    moments = {k: (np.zeros_like(v), np.zeros_like(v) if k not in ("word", "char") else np.zeros(1, F4)) for k, v in net.items()}

    for step in range(steps):
        chosen = np.concatenate([rng.choice(c, min(len(c), DOCS_A_STEP // 2), replace=False) for c in classes])
        numbers, start, owner = inputs.laid_out(chosen)
        here, numbers = np.unique(numbers, return_inverse=True)
        numbers, here = (numbers.reshape(-1, STRIDE), here[:-1]) if here[-1] == len(inputs.word) else (numbers.reshape(-1, STRIDE), here)
        x = inputs.vectors(net, here)
        logit = _logits(net, x, numbers, start)
        # a toxic document learns by windows drawn by the softmax of their logits, a clean one by its most toxic window; and some other clean ones
        label, last = y[chosen][owner], np.searchsorted(owner, np.arange(len(chosen)), "right") - 1
        drawn = [np.lexsort((logit + np.where(label == 1, rng.gumbel(size=len(logit)), 0), owner))[last] for _ in range(DRAWS)]
        top = np.concatenate([drawn[0], *(d[y[chosen] == 1] for d in drawn[1:])])
        clean = np.flatnonzero(label == 0)
        windows = np.concatenate([top, rng.choice(clean, min(len(clean), DOCS_A_STEP), replace=False)])
        word = numbers[(start[windows][:, None] + np.arange(LAP))].reshape(len(windows), WINDOW).T
        dropped = rng.random(len(x)) < DROPPED
        word = np.where(dropped[word], len(x) - 1, word)
        keep: dict = {}
        p = 1 / (1 + np.exp(-_forward(net, x[word], keep)))
        target = y[chosen][owner[windows]]
        weight = np.where(target == 1, 1 / max(1, (target == 1).sum()), np.where(np.arange(len(windows)) < len(top), 0.5 / max(1, (target[: len(top)] == 0).sum()), 0.5 / max(1, len(windows) - len(top))))
        d = ((p - target) * weight).astype(F4)
        g, dx = _backward(net, d, keep)
        flat, dx = word.ravel(), dx.reshape(-1, dx.shape[2])
        used, at = np.unique(flat, return_inverse=True)
        by_word = np.stack([np.bincount(at, dx[:, j], len(used)) for j in range(dx.shape[1])], 1).astype(F4)
        used, by_word = (used[:-1], by_word[:-1]) if used[-1] == len(x) - 1 else (used, by_word)
        g["word"], g["char"] = np.zeros_like(net["word"]), np.zeros_like(net["char"])
        used = here[used]
        np.add.at(g["word"], inputs.word[used], by_word[:, :WORD_DIM])
        size = inputs.run_count[used]
        np.add.at(g["char"], inputs.run[inputs.runs_of(used)], np.repeat(by_word[:, WORD_DIM:] / size[:, None].astype(F4), size, axis=0))
        rate = RATE * min(1, (step + 1) / 20) * (1 - 0.9 * step / steps)
        for k, v in net.items():
            m, s = moments[k]
            m += 0.1 * (g[k] - m)
            if k in ("word", "char"):
                # one scale for a whole table: what is met often moves further than what is met once
                touched = np.abs(g[k]).max(1) > 0
                s += 0.02 * ((g[k][touched] ** 2).mean() - s if touched.any() else 0)
                v *= F4(1 - DECAY)
                v -= (EMBEDDINGS_FASTER * rate * m / (np.sqrt(s / (1 - 0.98 ** (step + 1))) + 1e-8)).astype(F4)
            else:
                s += 0.01 * (g[k] * g[k] - s)
                v -= (rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.99 ** (step + 1))) + 1e-7)).astype(F4)

    # the cut that errs least on what was kept aside
    numbers, start, owner = inputs.laid_out(aside)
    scores, t = np.maximum.reduceat(_logits(net, inputs.vectors(net), numbers, start), np.searchsorted(owner, np.arange(len(aside)))), y[aside]
    order = np.argsort(scores)
    s, t = scores[order], t[order]
    wrong = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    middle = best[len(best) // 2]
    extras["shift"] = np.array([s[0] - 1 if middle == 0 else s[-1] + 1 if middle == len(s) else (s[middle - 1] + s[middle]) / 2], F4)
    return net | extras


def _bytes(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return texts(pa.array(values, pa.string()))


def top_logits(net: dict, inputs: Inputs) -> np.ndarray:
    """The greatest logit of each text's windows; minus infinity without words."""
    top = np.full(len(inputs.count), -np.inf)
    numbers, start, owner = inputs.laid_out()
    if len(start):
        some = np.flatnonzero(inputs.count)
        top[some] = np.maximum.reduceat(_logits(net, inputs.vectors(net), numbers, start), np.searchsorted(owner, some))
    return top


def score_texts(net: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Score of each text, to six digits; one without words scores the smaller of the sample's toxic share and 0.49."""
    base = float(net["base"][0])
    if "flat" in net:
        return np.full(len(offsets) - 1, base)
    top = top_logits(net, Inputs(data, offsets))
    return np.where(np.isfinite(top), np.round(1 / (1 + np.exp(-np.clip(top - net["shift"][0], -30, 30))), 6), min(base, 0.49))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % 5 == 0, F.lit(False))


def sample_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_PER_CLASS) -> DataFrame:
    """At most `most` labelled documents of each class that aren't held out, picked by a hash of doc_id, as doc_id, toxic, text.

    Of conflicting labels of one doc_id the toxic one counts, and of its repeated rows the least text.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    ranked = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64(F.lit(4), "doc_id"))
    picked = [ranked.filter(F.col("toxic") == b).orderBy("h", "doc_id").limit(most) for b in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]).select("doc_id", "toxic"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def training_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_PER_CLASS) -> list[tuple[str, int]]:
    """`sample_rows` as (text, label) pairs in the driver, by doc_id."""
    return [(r["text"], r["toxic"]) for r in sorted(sample_rows(docs, labels, most).collect(), key=lambda r: r["doc_id"])]


def learnt(docs: DataFrame, labels: DataFrame, most: int = MOST_PER_CLASS) -> dict:
    """`train` on `training_sample`, in one task: only the network, some MB, comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [pair for batch in batches for pair in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist())]
        out = io.BytesIO()
        np.savez(out, **train(sample))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["net"])

    rows = sample_rows(docs, labels, most).repartition(1).sortWithinPartitions("doc_id")
    found = rows.mapInArrow(run, "net binary").collect()
    if not found:  # an empty sample may get no task
        return train([])
    with np.load(io.BytesIO(found[0]["net"])) as net:
        return dict(net)


def toxicity(docs: DataFrame, net: dict) -> DataFrame:
    """docs' rows as doc_id, held_out, score, predicted, by a trained network.

    Null and empty texts score as texts without words. Repeated rows get equal scores, a null doc_id is not held out, an empty table gives
    no rows; other columns are not read. The network has a fixed size of some MB.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            scores = score_texts(model.value, *texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, net: dict) -> DataFrame:
    """docs less the rows whose text scores 0.5 or more; columns and other rows stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield batch.filter(pa.array(score_texts(model.value, *texts(batch.column("text"))) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, learnt(docs, table(spark, sf_dir, "labels")))
