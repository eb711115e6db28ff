import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from ledgerline.llm import toxicity

F4 = np.float32


def squash(x):
    return x / (1 + abs(x))


def plain_logit(net, words):
    """A window's logit, state by state; None is what lies beyond a text's end."""
    vectors = [np.zeros(toxicity.WORD_DIM + toxicity.CHAR_DIM) if w is None else toxicity.Inputs(*toxicity._bytes([w])).vectors(net)[0].astype(float) for w in words]
    states = {}
    for way, order in (("f", range(len(words))), ("b", reversed(range(len(words))))):
        h, size = np.zeros(toxicity.HIDDEN), toxicity.HIDDEN
        for t in order:
            x, u = vectors[t] @ net["w" + way] + net["c" + way], net["u" + way]
            z = 0.5 + 0.5 * squash(x[:size] + h @ u[:, :size])
            r = 0.5 + 0.5 * squash(x[size : 2 * size] + h @ u[:, size : 2 * size])
            n = squash(x[2 * size :] + r * (h @ u[:, 2 * size :]))
            h = (1 - z) * n + z * h
            states[way, t] = h
    both = [np.concatenate([states["f", t], states["b", t]]) for t in range(len(words))]
    e = np.array([squash(s @ net["wa"] + net["ca"]) @ net["va"] for s in both])
    e = np.exp(e) / np.exp(e).sum()
    return sum(a * (s @ net["wo"]) for a, s in zip(e, both)) + net["co"][0]


def plain_score(net, text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    if not words:
        return min(float(net["base"][0]), 0.49)
    best = -np.inf
    for k in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        window = words[k : k + toxicity.WINDOW]
        best = max(best, plain_logit(net, window + [None] * (toxicity.WINDOW - len(window))))
    return 1 / (1 + np.exp(-(best - net["shift"][0])))


@pytest.fixture(scope="module")
def random_net():
    rng = np.random.default_rng(8)
    net = toxicity.new_net() | {"base": np.array([0.3], F4), "shift": np.array([0.1], F4)}
    return net | {k: rng.normal(size=net[k].shape).astype(F4) for k in ("word", "char")}


def test_scores_against_a_plain_network(random_net):
    rng = np.random.default_rng(9)
    texts = [" ".join("".join(rng.choice(list("abcdefgé"), int(rng.integers(1, 8)))) for _ in range(n)) for n in (1, 3, 31, 32, 33, 40, 41, 300)] + ["", " 12 !", "One, two; THREE.", "x" * 5000]
    scores = toxicity.score_texts(random_net, *toxicity._bytes(texts))
    for text, score in zip(texts, scores, strict=True):
        assert abs(score - plain_score(random_net, text)) < 1e-4
        assert toxicity.score_texts(random_net, *toxicity._bytes([text]))[0] == pytest.approx(score, abs=2e-6)
    assert toxicity.score_texts(random_net, *toxicity._bytes(["a " * 100_000]))[0] > 0


def test_all_overlapping_windows():
    inputs = toxicity.Inputs(*toxicity._bytes(["a", "", " ".join(["b"] * 33), " ".join("c" * 1 for _ in range(100))]))
    numbers, start, owner = inputs.laid_out()
    assert np.bincount(owner, minlength=4).tolist() == [1, 0, 2, 10]
    covered = {k: set() for k in range(4)}
    for s, o in zip(start, owner, strict=True):
        assert len(numbers[s : s + toxicity.LAP].ravel()) == toxicity.WINDOW
        covered[o] |= set(range(toxicity.STRIDE * (s - start[owner == o][0]), toxicity.STRIDE * (s - start[owner == o][0]) + toxicity.WINDOW))
    assert all(set(range(n)) <= covered[k] for k, n in enumerate((1, 0, 33, 100)))


def test_inputs_in_pieces(random_net, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(list("abcdé"), int(rng.integers(1, 7)))) for _ in range(n)) for n in (5, 0, 400, 33, 900, 1)]
    whole = toxicity.Inputs(*toxicity._bytes(texts))
    monkeypatch.setattr(toxicity, "pieces", lambda batches, column: (b.slice(k, 1) for b in batches for k in range(b.num_rows)))
    parts = toxicity.Inputs.of_texts(texts)
    for name in ("distinct", "of", "first", "count", "word", "run", "run_first", "run_count"):
        assert (getattr(whole, name) == getattr(parts, name)).all(), name
    assert (whole.vectors(random_net) == parts.vectors(random_net)).all()


def test_gradients(random_net):
    net = {k: v.astype(np.float64) for k, v in random_net.items()}
    rng = np.random.default_rng(7)
    x = rng.normal(size=(5, 3, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    d, keep = np.array([1.0, -0.5, 2.0]), {}
    toxicity._forward(net, x, keep)
    g, dx = toxicity._backward(net, d, keep)
    loss = lambda: (toxicity._forward(net, x, {}) * d).sum()
    for name, where, got in [(n, tuple(0 for _ in net[n].shape), None) for n in ("wf", "uf", "ub", "wa", "va", "wo", "cb")] + [("x", (2, 1, 3), dx[2, 1, 3])]:
        values = x if name == "x" else net[name]
        old, e = values[where], 1e-2
        values[where] = old + e
        up = loss()
        values[where] = old - e
        down = loss()
        values[where] = old
        want = g[name][where] if got is None else got
        assert abs((up - down) / (2 * e) - want) < 2e-3 + 0.02 * abs(want), name


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    n = labels.sum()
    return (order[labels == 1].sum() - n * (n - 1) / 2) / (n * (len(labels) - n))


def test_learns_words_and_their_parts():
    rng = np.random.default_rng(6)
    clean = lambda n: " ".join("".join(rng.choice(["ka", "lo", "mi", "tu", "re"], 2)) for _ in range(n))
    sample = []
    for i in range(240):
        w = clean(int(rng.integers(20, 120))).split()
        if i % 4 == 0:
            w[len(w) // 2] = ["Zorgle", "vexot!!", "vexump", "vexilo"][int(rng.integers(4))]
        sample.append((" ".join(w), int(i % 4 == 0)))
    net = toxicity.train(sample[:160], steps=200)
    scores = toxicity.score_texts(net, *toxicity._bytes([t for t, _ in sample[160:]] + ["", "vexanu ka"]))
    assert ((scores[:80] >= 0.5) == np.array([y for _, y in sample[160:]])).mean() > 0.9 and (scores >= 0).all() and (scores <= 1).all()
    # a word never met, by its characters
    assert scores[-1] > np.median(scores[:80])


def test_recurrence_reads_order():
    """Texts are toxic where one word stands before another: with states that forget what came before, the network can't tell."""
    rng, sample = np.random.default_rng(3), []
    for i in range(900):
        w = ["ka", "lo", "mi", "tu"] * 3
        a, b = sorted(rng.choice(12, 2, replace=False))
        w[a], w[b] = ("zorg", "vexu") if i % 2 else ("vexu", "zorg")
        sample.append((" ".join(w), i % 2))
    net = toxicity.train(sample[:600], steps=600)
    inputs, labels = toxicity.Inputs(*toxicity._bytes([t for t, _ in sample[600:]])), np.array([y for _, y in sample[600:]])
    whole = auc(toxicity.top_logits(net, inputs), labels)
    # no recurrent weights, and update gates that keep nothing
    cut = {f"u{w}": 0 * net[f"u{w}"] for w in "fb"} | {f"c{w}": np.where(np.arange(3 * toxicity.HIDDEN) < toxicity.HIDDEN, F4(-1e6), net[f"c{w}"]) for w in "fb"}
    without = auc(toxicity.top_logits(net | cut, inputs), labels)
    assert whole > 0.9 and without < 0.7


def test_sample_and_held_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "own") for i in range(40)] + [(3, "another", "own"), (None, None, "own")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels, 5)
    kept = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert len(sample) == 10 and sum(y for _, y in sample) == 5 and {int(t.split()[-1]) for t, _ in sample if t != "another"} <= set(kept)
    assert sample == toxicity.training_sample(docs, labels, 5)
    rows = toxicity.toxicity(docs, toxicity.train(sample, steps=3)).collect()
    assert len(rows) == 42 and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    left = toxicity.without_toxic(docs, toxicity.train([("a", 1)]))
    assert left.collect() == [] and left.columns == docs.columns


def test_learns_in_a_task(spark, tmp_path, monkeypatch):
    texts = [None, ""] + [f"alpha beta w{i} " + ("zorgle" if i % 2 else "fine") for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("zorgle" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, toxic int")
    want = toxicity.train(toxicity.training_sample(docs, labels))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    came, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: came.extend(rows := collect(df)) or rows)
    net = toxicity.learnt(docs, labels)
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert came and not any(isinstance(v, str) for r in came for v in r)  # no text comes to the driver
    assert net.keys() == want.keys() and all(np.allclose(net[k], want[k], atol=1e-4) and net[k].dtype == want[k].dtype for k in want)
    assert not any("zorgle" in (r["text"] or "") for r in collect(kept)) and kept.count() >= 30
    for some in (labels.limit(0), labels.filter("toxic = 1")):
        flat = toxicity.learnt(docs, some)
        assert flat["flat"] and flat["base"] == toxicity.train(toxicity.training_sample(docs, some))["base"]
