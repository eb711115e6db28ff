import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from ledgerline.llm import mixing, sentencepiece, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    lines, long = "\n".join(say(6) for _ in range(4)), say(150).split()
    texts = [None, "", "one", say(40), "\n".join([say(5), lines, say(5)]), "\n".join([say(5), lines]), lines, " ".join(long), " ".join([*long[:-1], "end"]), " ".join(long), say(4000)]
    texts += [say(30) for _ in range(30)] + [say(15) + " zorgle " + say(14) for _ in range(30)]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t), "own") for i, t in enumerate(texts)] + [(None, say(9), None, None, 1, "own"), (3, texts[3], "en", "s0", 1, "own")]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i > 40)) for i in range(11, 71)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def shingles(t):
    w = WORD.findall(t or "")
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_stages_against_plain_ones(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram join", "mixing", "sentencepiece"]

    net = toxicity.train(toxicity.training_sample(docs, spark.read.parquet(f"{tables}/labels.parquet")))
    out = by_name["toxicity"](spark, docs, tables)
    want = [r for r in rows_of(docs) if toxicity.score_texts(net, *toxicity._bytes([r[1]]))[0] < 0.5]
    assert out.columns == docs.columns and Counter(rows_of(out)) == Counter(want) and len(want) < docs.count() and all("zorgle" not in (r[1] or "") for r in want)

    kept = spark.createDataFrame(want, SCHEMA)
    out, seen, clean = by_name["line dedup"](spark, kept, tables), set(), []
    for r in sorted(set(want), key=lambda r: -1 if r[0] is None else r[0]):
        split, gone = (r[1] or "").split("\n"), set()
        for k in range(len(split) - 2):
            if "".join(split[k : k + 3]).strip():
                gone |= {k, k + 1, k + 2} if tuple(split[k : k + 3]) in seen else set()
                seen.add(tuple(split[k : k + 3]))
        if len(gone) < len(split):
            text = r[1] if not gone else "\n".join(x for k, x in enumerate(split) if k not in gone)
            clean += [(r[0], text, *r[2:4], r[4] if not gone else len(text), r[5])] * want.count(r)
    assert out.columns == docs.columns and Counter(rows_of(out)) == Counter(clean) and sum(len(r[1] or "") for r in clean) < sum(len(r[1] or "") for r in want)

    kept = spark.createDataFrame(clean, SCHEMA)
    out, sets = by_name["n-gram join"](spark, kept, tables), [shingles(r[1]) for r in clean]
    least = {}
    for i in range(len(clean)):
        reach, todo = {i}, [i]
        while todo:
            a = todo.pop()
            new = {j for j in range(len(clean)) if 9 * len(sets[a] & sets[j]) >= 4 * (len(sets[a]) + len(sets[j]))} - reach
            reach |= new
            todo += new
        least[i] = min((-1 if clean[j][0] is None else clean[j][0]) for j in reach)
    single = [r for i, r in enumerate(clean) if (-1 if r[0] is None else r[0]) == least[i]]
    assert out.columns == docs.columns and Counter(rows_of(out)) == Counter(single) and len(single) < len(clean)

    kept = spark.createDataFrame(single, SCHEMA)
    out, plan = by_name["mixing"](spark, kept, tables), Counter()
    for r in mixing.mix_sources(kept).collect():
        plan[r["doc_id"]] += r["taken"]
    mixed, words = rows_of(out), Counter()
    for r in mixed:
        words[r[0]] += len(WORD.findall(r[1]))
        whole = next(s for s in single if s[0] == r[0])
        assert r[2:4] == whole[2:4] and r[4] == len(r[1]) and r[5] == "own" and not Counter(WORD.findall(r[1])) - Counter(WORD.findall(whole[1]))
    assert out.columns == docs.columns and words == +plan

    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_proto=sentencepiece.default_model())
    got = rows_of(by_name["sentencepiece"](spark, spark.createDataFrame(mixed, SCHEMA), tables).select("doc_id", "ids", "n_ids", "round_trip"))
    want = [(r[0], lib.encode(r[1], num_threads=1)) for r in mixed]
    assert sorted((str(d), list(i), n, ok) for d, i, n, ok in got) == sorted((str(d), i, len(i), True) for d, i in want)

    ran = corpus_pipeline.run(spark, tables)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in ran.collect()) == sorted((str(d), i) for d, i in want)


def test_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).collect() == [], name


def test_decoding_gives_texts_back(spark):
    model, texts = sentencepiece.default_model(), ["", "One two  three ", "Ünï 日本 \n🙂", "x" * 20_000, "a b " * 30_000]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    encoded = sentencepiece.encode_documents(docs, model)
    back = {r["doc_id"]: r["text"] for r in sentencepiece.decode_documents(encoded, model).collect()}
    assert [back[i] for i in range(6)] == [*texts, ""]
