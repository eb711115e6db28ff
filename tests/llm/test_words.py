import re

import numpy as np
import pyarrow as pa

from ledgerline.llm.words import Words, texts

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_words_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        values = [None if rng.random() < 0.1 else "".join(rng.choice(list("ab \n\x1cé"), int(rng.integers(0, 6)))) for _ in range(int(rng.integers(1, 9)))]
        w = Words(*texts(pa.array(values, pa.string())))
        got = [[bytes(w.data[w.start[i] : w.end[i]]) for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
        assert got == [WORD.findall((v or "").encode()) for v in values] and w.count.tolist() == [len(g) for g in got]
        known = {}
        for word, h in zip([x for g in got for x in g], w.hash, strict=True):
            assert known.setdefault(word, h) == h
        assert len(set(known.values())) == len(known)


def test_an_empty_text_between_others():
    w = Words(*texts(pa.array(["abc", "", None, "def"], pa.string())))
    assert w.count.tolist() == [1, 0, 0, 1] and (w.end > w.start).all()
