"""SentencePiece encoding and decoding: forward passes over a trie of distinct marked words."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words of a generation whose encoding is kept between batches, the most characters of such a word, pairs whose verdict is kept, rows handed on at a time.
KEPT, LONG, PAIRS, ROWS = 200_000, 40, 300_000, 500
UNKNOWN = -1
# Kinds of models and of pieces in model files, and how far the score of an unknown character lies below the least one.
UNIGRAM, BYTE_PAIR, PENALTY = 1, 2, 10.0


class Vocabulary:
    """Pieces of a model and what all kinds of models share: words, the cache of their encodings, bytes, decoding.

    Words are cut before each run of marks, and at the line ends and tabs that no piece has. Encodings are kept in two
    generations: words that a full generation's time passes without go, frequent ones are handed on.
    """

    def __init__(self, model) -> None:
        """model: the public library's processor."""
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.text = {i: model.id_to_piece(i) for i in plain}
        self.unknown = model.unk_id()
        self.bytes_ = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = model.is_byte(self.bytes_[0])
        self.table = [b""] * size
        for i, p in self.text.items():
            self.table[i] = p.replace(MARK, " ").encode()
        if self.fallback:
            for b, i in enumerate(self.bytes_):
                self.table[i] = bytes([b])
        self.table[self.unknown] = " ⁇ ".encode()
        inner = {c for p in self.text.values() for c in p}
        self.splits = "".join(c for c in "\n\t\r" if c not in inner)
        if any(MARK in p.lstrip(MARK) for p in self.text.values()):
            raise ValueError("pieces go on over the start of a word")
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def learn(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Encode these distinct words in sorted order, which is a depth-first walk of their trie: what the forward pass found for the prefix that a word shares with the one before is kept."""
        raise NotImplementedError

    def unknown_ids(self, c: str) -> list[int]:
        """The identifiers of a character that no piece has."""
        return [self.bytes_[b] for b in c.encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown]

    def encode(self, texts: list[str], chars: int = 1 << 21) -> list[np.ndarray]:
        """Identifiers of each text; the words of about `chars` characters are held at a time."""
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= chars:
                out += self._encode(part)
                part, size = [], 0
        return out + self._encode(part)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        find = re.compile(f"[{self.splits}]|{MARK}+[^{MARK}{self.splits}]*|[^{MARK}{self.splits}]+" if self.splits else f"{MARK}+[^{MARK}]*").findall
        words = [find(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        got, fresh = {}, []
        for w in set(chain.from_iterable(words)):
            ids = self.known.get(w) or self.older.get(w)
            if ids:
                got[w] = ids
            else:
                fresh.append(w)
        got |= self.learn(fresh)
        if len(self.known) > KEPT:
            self.known, self.older = {}, self.known
        self.known.update((w, ids) for w, ids in got.items() if len(w) <= LONG)
        out = [np.fromiter(chain.from_iterable(map(got.__getitem__, w)), np.int32) for w in words]
        if not self.fallback:  # neighbours without a piece are one unknown
            out = [x[np.concatenate(([True], (x[1:] != self.unknown) | (x[:-1] != self.unknown)))] if len(x) else x for x in out]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of identifiers; bytes that are no UTF-8 become replacement characters."""
        raw = b"".join(map(self.table.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


class Unigram(Vocabulary):
    """A model of pieces with scores: Viterbi, the best sum of scores of all pieces that end at a position, earlier starts first among equals."""

    def __init__(self, model) -> None:
        super().__init__(model)
        self.score = {p: model.get_score(i) for i, p in self.text.items()}
        self.ids = {p: i for i, p in self.text.items()}
        self.longest = max(map(len, self.score), default=1)
        self.least = min(self.score.values(), default=0.0) - PENALTY

    def learn(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        out, score, before = {}, self.score, ""
        forward, start = [0.0], [0]  # by position of the present word: best sum, and where its last piece starts
        for w in sorted(words):
            k = 0
            for x, y in zip(w, before, strict=False):
                if x != y:
                    break
                k += 1
            del forward[k + 1 :], start[k + 1 :]
            for end in range(k + 1, len(w) + 1):
                best, at = None, end - 1
                for s in range(max(0, end - self.longest), end):
                    got = score.get(w[s:end])
                    if got is not None and (best is None or forward[s] + got > best):
                        best, at = forward[s] + got, s
                if w[end - 1] not in score and (best is None or forward[end - 1] + self.least > best):
                    best, at = forward[end - 1] + self.least, end - 1
                forward.append(best)
                start.append(at)
            before, ids, end = w, [], len(w)
            while end:
                piece = w[start[end] : end]
                ids.append([self.ids[piece]] if piece in score else self.unknown_ids(piece))
                end = start[end]
            out[w] = tuple(chain.from_iterable(reversed(ids)))
        return out


class BytePair(Vocabulary):
    """A model of merges, for which the best sum of scores is not what the model's own encoder gives.

    A word's pieces are the path through its positions on which every two neighbours are compatible: merging their
    characters from the start never joins across the border between them. Exactly one such path reaches each prefix,
    so a position's forward state is its last piece, and words with a common prefix share the states of that prefix.
    Pieces are ranked by merge, single characters first; suffix: ranks, and -2 for what only ends pieces.
    """

    def __init__(self, model) -> None:
        super().__init__(model)
        runs = {len(p): i for i, p in self.text.items() if len(p) > 1 and not p.strip(MARK)}
        self.ids = sorted((i for i in self.text if i not in runs.values()), key=lambda i: (len(self.text[i]) > 1, -model.get_score(i), i))
        pieces = self.pieces = [self.text[i] for i in self.ids]
        rank = self.rank = {p: r for r, p in enumerate(pieces)}
        self.left, self.right = [-1] * len(pieces), [-1] * len(pieces)
        dead = []
        for r, p in enumerate(pieces):
            parts = [rank.get(c, UNKNOWN) for c in p]
            while len(parts) > 1 and UNKNOWN not in parts:
                best = min((rank.get(pieces[a] + pieces[b], len(pieces)), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best[0] == len(pieces):
                    break
                pair = parts[best[1] : best[1] + 2]
                parts[best[1] : best[1] + 2] = [best[0]]
            if parts != [r]:
                dead.append(p)
            elif len(p) > 1:
                self.left[r], self.right[r] = pair
        if dead:
            raise ValueError(f"{len(dead)} pieces can't be made by merging, {dead[:5]}")
        self.suffix = {p[k:]: -2 for p in pieces for k in range(len(p))} | rank
        self.runs, self.run_ids = set(runs), runs | {1: self.ids[rank[MARK]]}
        self.verdicts: dict[int, bool] = {}
        self.run_known: dict[int, tuple[int, ...]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between pieces a and b as it is."""
        if a == UNKNOWN or b == UNKNOWN:
            return True
        key = a << 32 | b
        got = self.verdicts.get(key)
        if got is None:
            if len(self.verdicts) > PAIRS:
                self.verdicts.clear()
            got = self.verdicts[key] = self._border(a, b)
        return got

    def _border(self, a: int, b: int) -> bool:
        # the pieces that touch the border are taken apart again, the later merge first; a pair that would have merged earlier than the one just undone crosses the border
        rank, pieces, undone = self.rank, self.pieces, len(self.pieces) + 1
        while True:
            if rank.get(pieces[a] + pieces[b], undone) < undone:
                return False
            if a > b and self.left[a] >= 0:
                undone, a = a, self.right[a]
            elif self.left[b] >= 0:
                undone, b = b + 1, self.left[b]
            elif self.left[a] >= 0:
                undone, a = a, self.right[a]
            else:
                return True

    def _run(self, n: int) -> tuple[int, ...]:
        """Identifiers of n marks that no word took: merged from the left, as all such pieces rank the same."""
        got = self.run_known.get(n)
        if got is None:
            done: list[int] = []
            for _ in range(n):
                done.append(1)
                while len(done) > 1 and done[-2] + done[-1] in self.runs:
                    done.append(done.pop() + done.pop())
            got = self.run_known[n] = tuple(self.run_ids[k] for k in done)
        return got

    def learn(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        known: dict[str, tuple[int, ...]] = {}
        rank, suffix, verdicts, compatible = self.rank, self.suffix, self.verdicts, self.compatible
        before, last, size = "", [UNKNOWN], [0]
        for w in sorted(words):
            core = w[max(0, len(w) - len(w.lstrip(MARK)) - 1) :] if w[:2] == MARK + MARK else w
            marks = len(w) - len(core)
            n, k = len(core), 0
            for x, y in zip(core, before, strict=False):
                if x != y:
                    break
                k += 1
            del last[k + 1 :], size[k + 1 :]
            for end in range(k + 1, n + 1):
                start, piece = end - 1, suffix.get(core[end - 1])
                while piece is not None:
                    if piece >= 0:
                        if not start or (a := last[start]) < 0:
                            break
                        ok = verdicts.get(a << 32 | piece)
                        if compatible(a, piece) if ok is None else ok:
                            break
                    start -= 1
                    piece = suffix.get(core[start:end]) if start >= 0 else None
                if piece is None:  # a character that no piece has
                    start, piece = end - 1, UNKNOWN
                last.append(piece)
                size.append(end - start)
            before, out, end = core, [], n
            while end:
                out.append(last[end] if last[end] != UNKNOWN else core[end - 1])
                end -= size[end]
            out.reverse()
            ids = [i for x in out for i in ([self.ids[x]] if isinstance(x, int) else self.unknown_ids(x))]
            if marks:
                if out and out[0] == rank.get(MARK):
                    marks, ids = marks + 1, ids[1:]
                ids = [*self._run(marks), *ids]
            known[w] = tuple(ids)
        return known


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in the public wire format of model files."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = raw[at]
            at += 1
            n |= (byte & 127) << shift
            if byte < 128:
                return n
            shift += 7

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, raw[at : at + size]
            at += size


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a unigram or byte-pair model, read by the public library. Models that change texts (normalise them, or drop spaces) are refused."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    top = [f for f in _fields(model.serialized_model_proto()) if f[0] in (2, 3)]
    trainer, norm = (dict(chain.from_iterable(_fields(v) for k, v in top if k == n)) for n in (2, 3))
    if norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1):
        raise ValueError("the model changes texts before it encodes them")
    kind = {UNIGRAM: Unigram, BYTE_PAIR: BytePair}.get(trainer.get(3, UNIGRAM))
    if kind is None:
        raise ValueError("neither a unigram nor a byte-pair model")
    return kind(model)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The columns of `docs` and ids array<int>, decoded string.

    Null and empty texts have no identifiers and the empty text; repeated rows stay; columns named ids or decoded are
    replaced; an empty table gives an empty result. Texts are encoded whole, very long ones too: the distinct words of
    about two megabytes of text at a time. The driver reads the model and hands it to the executors.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col("text").cast("string").alias("_text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        gc.disable()  # the cache is millions of objects without a cycle, which the collector would walk over and over
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):  # what comes out of a batch is handed on in parts
                part = batch.slice(at, ROWS)
                ids = v.encode([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(list(map(v.decode, ids)), pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
