"""1. SentencePiece encoding and decoding by streaming Viterbi.

The lattice of pieces is searched from left to right. Only a window of the
longest piece's length can still grow a path, so only its ends survive; when
their back pointers all lead through one boundary, what lies before it is
committed and forgotten.

A unigram model's best path has the greatest sum of scores. A BPE model's path
is the one that merging gives: a piece may follow another only if merging their
text gives just these two, which leaves one surviving path at each end.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .words import pieces

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: The library's charge for a character that no piece covers, below the least score.
UNKNOWN_CHARGE = 10.0
#: Words, parts and pairs of pieces that each worker keeps in a generation, and the longest word or part kept. Others are worked out whenever they come.
MOST_KEPT = 200_000
MOST_PAIRS = 300_000
LONGEST_KEPT = 40


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError("not a SentencePiece model")
        yield tag >> 3, value


class Latest:
    """What was used latest: two generations of `most` entries, of which the older goes once the newer is full."""

    def __init__(self, most: int):
        self.most = most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def keep(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def older(self, key: str) -> bytes | None:
        found = self.old.get(key)
        if found is not None:
            self.keep(key, found)
        return found


class Model:
    """Pieces and settings of a serialised model. Its normaliser must not map characters."""

    def __init__(self, serialised: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.prefix, self.squeeze = UNIGRAM, True, True
        for number, value in _fields(serialised):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                settings = dict(_fields(value))
                if settings.get(2):
                    raise ValueError("models that normalise characters are not supported")
                self.prefix, self.squeeze = bool(settings.get(3, 1)), bool(settings.get(4, 1))
        self._ready()

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], kind: int, prefix: bool = True, squeeze: bool = False) -> Model:
        self = cls.__new__(cls)
        self.pieces, self.kind, self.prefix, self.squeeze = pieces, kind, prefix, squeeze
        self._ready()
        return self

    def _ready(self) -> None:
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k in (NORMAL, USER)}
        self.scores = [s for _, s, _ in self.pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.rank = {p: -self.scores[i] for p, i in self.ids.items()}
        self.no_rank = float("inf")
        #: The pieces as a tree: character -> (id or -1, what may come next).
        self.trie: dict = {}
        for p, i in self.ids.items():
            at = self.trie
            for c in p[:-1]:
                at = at.setdefault(c, [-1, {}])[1]
            at.setdefault(p[-1], [-1, {}])[0] = i
        #: Characters that stand side by side in some piece.
        self.joined = {pair for p in self.ids for pair in zip(p, p[1:])}
        self.charge = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_CHARGE
        self.out = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNUSED) else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, k in self.pieces]
        #: No piece goes on from a word into the next, so paths always converge where a word begins.
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.names = [p for p, _, _ in self.pieces]  # then characters that are no piece
        self.others: dict[str, int] = {}  # at most one a character
        #: Whether piece b may follow piece a (-1: the beginning): valid[a][b].
        self.valid: dict[int, dict[int, bool]] = {}
        self.known = 0
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.none: dict[int, bool] = {}
        #: Ids of words and of their parts alike, as a part by itself is encoded as a word would be.
        self.kept = Latest(MOST_KEPT)

    def _single(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        raw = char.encode()
        return [self.bytes[b] for b in raw] if len(self.bytes) == 256 else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """What merging gives: the adjacent pair whose union scores best, leftmost first, again and again."""
        rank, none = self.rank, self.no_rank
        symbols = list(text)
        ranks = [rank.get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(symbols[i] + symbols[i + 1], none)
            if i:
                ranks[i - 1] = rank.get(symbols[i - 1] + symbols[i], none)
        return symbols

    def _number(self, char: str) -> int:
        """A number past the pieces' ids for a character that is no piece."""
        found = self.others.get(char)
        if found is None:
            found = self.others[char] = len(self.names)
            self.names.append(char)
        return found

    def _edges(self, n: int) -> tuple[list, list] | None:
        """What stands first and last in a piece while its characters merge, each with the rank of the merge that ends it. None if merging doesn't give the piece, or not by ever worse ranks."""
        if n in self.edges:
            return self.edges[n]
        rank, none = self.rank, self.no_rank
        symbols = list(self.names[n])
        first, last, latest = [], [], -none
        ranks = [rank.get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none or best < latest:
                break
            latest, i = best, ranks.index(best)
            if i == 0:
                first.append((symbols[0], best))
            if i == len(ranks) - 1:
                last.append((symbols[-1], best))
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(symbols[i] + symbols[i + 1], none)
            if i:
                ranks[i - 1] = rank.get(symbols[i - 1] + symbols[i], none)
        found = None if ranks else (first + [(symbols[0], none)], last + [(symbols[0], none)])
        self.edges[n] = found  # at most one a piece or character
        return found

    def _follows(self, a: int, b: int) -> bool:
        """Whether merging the text of pieces a and b gives just the two; a < 0: whether merging b's characters gives b."""
        if a < 0:
            found = self.merged(self.names[b]) == [self.names[b]]
        else:
            found = self._parts(a, b)
        if self.known >= MOST_PAIRS:
            self.known = 0
            self.valid.clear()
        self.known += 1
        self.valid.setdefault(a, {})[b] = found
        return found

    def _parts(self, a: int, b: int) -> bool:
        left, right, rank = self._edges(a), self._edges(b), self.rank
        if left is None or right is None:
            return self.merged(self.names[a] + self.names[b]) == [self.names[a], self.names[b]]
        # what stands on either side of the border at a time must not merge before one of the two is merged into its own piece
        left, right = left[1], right[0]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            across = rank.get(x + y)
            if across is not None and (across < x_ends if x_ends <= y_ends else across <= y_ends):
                return False
            if x_ends == y_ends == self.no_rank:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _numbers(self, text: str) -> Iterator[list[int]]:
        """Numbers of the best path's pieces, given out as soon as all surviving paths share them; the lattice is held from the last commitment on."""
        top, longest, bpe, scores, charge = self.trie, self.longest, self.kind == BPE, self.scores, self.charge
        base, size, wide = 0, len(text), 2 * self.longest  # base: committed so far
        look = wide  # where surviving paths are next traced back; paths that don't meet put it off by what was traced, so all looks together take linear time
        back: dict[int, int] = {0: 0}  # end of a path -> start of its last piece
        last: dict[int, int] = {0: -1}  # -> number of its last piece
        best: dict[int, float] = {0: 0.0}
        for start in range(size):
            children, stop = top, start
            if bpe:
                before = last.get(start)
                if before is None:
                    raise ValueError(f"no path through {text[max(0, start - longest) : start]!r}")
                row = self.valid.get(before, self.none)
                while children and stop < size:
                    found = children.get(text[stop])
                    if found is None:
                        break
                    piece, children = found
                    stop += 1
                    # one path alone survives at an end, and the first to reach it is of the longest piece
                    if piece >= 0 and stop not in last:
                        fits = row.get(piece)
                        if fits or fits is None and self._follows(before, piece):
                            last[stop], back[stop] = piece, start
                if start + 1 not in last and text[start] not in self.ids:
                    piece = self._number(text[start])
                    if self._follows(before, piece):
                        last[start + 1], back[start + 1] = piece, start
            else:
                score = best[start]
                while children and stop < size:
                    found = children.get(text[stop])
                    if found is None:
                        break
                    piece, children = found
                    stop += 1
                    if piece >= 0 and (stop not in best or score + scores[piece] > best[stop]):
                        best[stop], last[stop], back[stop] = score + scores[piece], piece, start
                if text[start] not in self.ids and (start + 1 not in best or score + charge > best[start + 1]):
                    best[start + 1], last[start + 1], back[start + 1] = score + charge, self._number(text[start]), start
            if start >= look:
                # ends from which a path can still grow; the latest steps back until all have met
                live = {end for end in back if end > start}
                while len(live) > 1:
                    end = max(live)
                    live.remove(end)
                    live.add(max(back[end], base))
                meet = live.pop() if live else base
                if meet > base:
                    yield self._path(back, last, base, meet)
                    for end in [end for end in back if end < meet]:
                        del back[end], last[end]
                        best.pop(end, None)
                    base = meet
                look = start + max(wide, (start - base) // 2)
        if size not in last:
            raise ValueError(f"no path through {text[max(0, size - longest) :]!r}")
        yield self._path(back, last, base, size)

    @staticmethod
    def _path(back: dict[int, int], last: dict[int, int], start: int, end: int) -> list[int]:
        found = []
        while end > start:
            found.append(last[end])
            end = back[end]
        return found[::-1]

    def viterbi(self, text: str) -> Iterator[str]:
        """The best path's pieces."""
        for part in self._numbers(text):
            yield from map(self.names.__getitem__, part)

    def _encode_run(self, run: str) -> bytes:
        """Ids of a run, each part between neighbours that stand together in no piece by itself: every path has a boundary there."""
        out, start, joined, kept = [], 0, self.joined, self.kept
        for end in [i for i, pair in enumerate(zip(run, run[1:]), 1) if pair not in joined] + [len(run)]:
            cell = run[start:end]
            ids = None if len(cell) == len(run) else kept.new.get(cell) or kept.older(cell)
            if ids is None:
                numbers: list[int] = []
                for part in self._numbers(cell):
                    for n in part:
                        if n < len(self.pieces):
                            numbers.append(n)
                        else:
                            numbers += self._single(self.names[n])
                ids = np.array(numbers, np.int32).tobytes()
                if len(cell) <= LONGEST_KEPT and len(cell) < len(run):
                    kept.keep(cell, ids)
            out.append(ids)
            start = end
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; an empty one has none. U+2581 in the text itself is spelt in bytes, so that decoding gives it back."""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return np.empty(0, np.int32)
        if SPACE in text and len(self.bytes) == 256:
            mark = np.array(self._single(SPACE), np.int32)
            parts = [self._spaced(("" if i or not self.prefix else SPACE) + p.replace(" ", SPACE)) for i, p in enumerate(text.split(SPACE))]
            return np.concatenate([x for p in parts for x in (mark, p)][1:])
        return self._spaced((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def _spaced(self, text: str) -> np.ndarray:
        kept, out = self.kept, []
        for run in re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text) if self.by_word else [text] if text else []:
            ids = kept.new.get(run) or kept.older(run)
            if ids is None:
                ids = self._encode_run(run)
                if len(run) <= LONGEST_KEPT:
                    kept.keep(run, ids)
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, less the space put before it."""
        out = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if self.prefix and out.startswith(" ") else out


_MODELS: dict[int, Model] = {}


def _model(serialised: bytes) -> Model:
    """One model a worker, so that kept words serve all its tasks."""
    key = hash(serialised)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(serialised)
    return _MODELS[key]


def encode_documents(docs: DataFrame, serialised: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, ids, n_ids, round_trip (whether decoding the ids gives the text back).

    A null or empty text has no ids. Repeated rows give equal rows, an empty table none; other columns are not read. The model's bytes
    (some MB at most) go to the workers with the job.
    """
    model = docs.sparkSession.sparkContext.broadcast(serialised)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model.value)
        for batch in pieces(batches, "text", 4_000_000):
            found, same = [], []
            for text in batch.column("text").to_pylist():
                ids = m.encode(text or "")
                found.append(ids)
                same.append(m.decode(ids) == (text or ""))
            counts = np.array([len(x) for x in found], np.int64)
            flat = np.concatenate(found) if found else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(counts), pa.array(same)], ["doc_id", "ids", "n_ids", "round_trip"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode_documents(rows: DataFrame, serialised: bytes) -> DataFrame:
    """(doc_id, ids) back to (doc_id, text); null ids give an empty text."""
    model = rows.sparkSession.sparkContext.broadcast(serialised)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model.value)
        for batch in batches:
            texts = [m.decode(np.array(x or [], np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def default_model(path: str | None = None) -> bytes:
    """Bytes of the model file at `path`, by default of the installed public tokenizers. Read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), default_model())
