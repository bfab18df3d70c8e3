"""Packing: examples go into sequences by the dot-product heuristic for vector bins, under limits on tokens, segments and tokens that bear loss."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/word_bpe_49k.json"
#: Identifier after each example, tokens of a sequence, its segments, those of its tokens that bear loss.
END, TOKENS, SEGMENTS, LOSS = 2, 4096, 256, 4096
#: No cut leaves a piece of fewer tokens, and a gap of fewer is padded.
LEAST = 16
#: A pool is packed when it holds so many tokens or examples; characters encoded at a time; distinct words remembered.
POOL, EXAMPLES, CHARS, WORDS = 1_000_000, 16_384, 8 << 20, 1_000_000
#: Words encoded in one go, and stops that may follow a word's letters.
JOINED, STOPS = 256, ".,;:!?"
# Fixed value: what ends the last piece of a word in the tokenizer's vocabulary.
WORD_END = "</w>"
SCHEMA = "doc_id long, start long, length long, ids binary, loss long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """The public tokenizer's identifiers of texts, which it splits at white space: each distinct stretch is encoded once, then looked up.

    No token and no step before tokens reaches over ASCII white space, so a text's identifiers are its stretches' in
    order. What is remembered is forgotten at WORDS stretches.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(WORD_END) for i in range(size)])
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        """Words of letters, with stops after them or not, are encoded some at a time: each stretch of letters, and each of stops, ends with an identifier that ends words."""
        parts = np.fromiter((1 if w.isalpha() else 2 if w.rstrip(STOPS).isalpha() else 0 for w in words), np.int64, len(words))
        order = np.argsort(parts == 0, kind="stable")  # the others come last, each by itself
        plain = np.count_nonzero(parts)
        words, parts = [words[i] for i in order.tolist()], parts[order]
        got = []
        for s, x in zip(range(0, plain, JOINED), self.tokenizer.encode_batch_fast([" ".join(words[s : min(s + JOINED, plain)]) for s in range(0, plain, JOINED)], add_special_tokens=False), strict=True):
            ids, own = np.array(x.ids, np.uint32), parts[s : min(s + JOINED, plain)]
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == own.sum():
                got.append((ids, np.diff(ends[np.cumsum(own) - 1], prepend=0)))
            else:  # some letter isn't one to the tokenizer
                got.append(self._single(words[s : s + len(own)]))
        got.append(self._single(words[plain:]))
        size = np.concatenate([x for _, x in got])
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, *(x for x, _ in got)))

    def _single(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all words, and each one's number."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.uint32, int(size.sum())), size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The identifiers of all texts, and for each text where its own end."""
        if len(self.place) > WORDS:
            self.forget()
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if new := [w for w in distinct if w not in self.place]:
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy(zero_copy_only=False)]
        size = self.size[at]
        end = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[at] - end + size, size) + np.arange(end[-1] if len(end) else 0)]
        return ids, np.concatenate(([0], end))[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The encoder of a worker process."""
    return Encoder(path)


class Packer:
    """Fills sequences from a pool of examples.

    An example is a vector (tokens, segments, tokens that bear loss). A sequence takes, again and again, the example
    of those that fit whole whose vector has the largest dot product with the room left, each dimension weighted by the
    pool's demand for it. With `cut`, a gap of LEAST tokens or more is then filled by the head of the longest example;
    its rest opens the next sequence.
    """

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool) -> None:
        self.limit, self.cut = np.array([tokens, segments, loss], np.int64), cut
        self.waiting: list[tuple] = []
        self.held = 0
        self.rest: tuple | None = None

    def add(self, key, ids: np.ndarray, bears: np.ndarray | None) -> Iterator[list[tuple]]:
        """Take an example; back come the sequences that its full stretches make alone. bears: its tokens that bear loss, None: all."""
        total = len(ids)
        start = 0
        while start < total:
            n = self._longest(bears, start, total)
            piece = (key, start, ids[start : start + n], None if bears is None else bears[start : start + n], total)
            if n == self.limit[0]:
                yield [piece]
            else:
                self.waiting.append(piece)
                self.held += n
            start += n

    def _longest(self, bears: np.ndarray | None, start: int, end: int, tokens: int | None = None, loss: int | None = None) -> int:
        """Tokens from start on that fit the room."""
        n = min(end - start, int(self.limit[0]) if tokens is None else tokens)
        loss = int(self.limit[2]) if loss is None else loss
        return min(n, loss) if bears is None else int(np.searchsorted(np.cumsum(bears[start : start + n]), loss, side="right"))

    def full(self) -> bool:
        return self.held >= POOL or len(self.waiting) >= EXAMPLES

    def pack(self, last: bool) -> Iterator[list[tuple]]:
        """Sequences, as lists of pieces, from the pool. What makes less than a sequence waits, unless this is the last call."""
        if not self.held:
            return
        vector = np.array([(len(p[2]), 1, len(p[2]) if p[3] is None else int(p[3].sum())) for p in self.waiting], np.int64).reshape(-1, 3)
        kinds, kind = np.unique(vector, axis=0, return_inverse=True)
        of: list[list[tuple]] = [[] for _ in kinds]
        for k, p in zip(kind.ravel().tolist(), self.waiting, strict=True):
            of[k].append(p)
        left = np.bincount(kind.ravel(), minlength=len(kinds)).astype(np.int64)
        share = kinds / self.limit
        while self.held and (last or self.held >= self.limit[0]):
            weight = (share * left[:, None]).sum(0) + 1e-9
            room, sequence = self.limit.copy(), []

            def put(piece: tuple) -> None:
                sequence.append(piece)
                room[:] -= (len(piece[2]), 1, len(piece[2]) if piece[3] is None else int(piece[3].sum()))
                self.held -= len(piece[2])

            if self.rest:
                rest, self.rest = self.rest, None
                put(rest)
            while (fits := (left > 0) & (kinds <= room).all(1)).any():
                score = share @ (weight * room / self.limit)
                k = int(np.argmax(np.where(fits, score, -1.0)))
                left[k] -= 1
                put(of[k].pop())
            if self.cut and room[0] >= LEAST and room[1] > 0 and left.any():
                k = int(np.argmax(np.where(left > 0, kinds[:, 0], -1)))
                key, start, ids, bears, total = of[k][-1]
                n = min(self._longest(bears, 0, len(ids), int(room[0]), int(room[2])), len(ids) - LEAST)
                if n >= LEAST:
                    of[k].pop()
                    left[k] -= 1
                    put((key, start, ids[:n], None if bears is None else bears[:n], total))
                    self.rest = (key, start + n, ids[n:], None if bears is None else bears[n:], total)
            yield from self._powers(sequence) if self.cut and room[0] >= LEAST else [sequence]
        self.waiting = [p for x in of for p in x]

    def _powers(self, sequence: list[tuple]) -> Iterator[list[tuple]]:
        """A sequence with a gap, cut into sequences whose lengths are powers of two, which need no padding."""
        length = sum(len(p[2]) for p in sequence)
        out, room = [], 1 << length.bit_length() - 1
        for key, start, ids, bears, total in sequence:
            while len(ids):
                n = min(len(ids), room)
                out.append((key, start, ids[:n], None if bears is None else bears[:n], total))
                start, ids, bears = start + n, ids[n:], None if bears is None else bears[n:]
                room, length = room - n, length - n
                if not room:
                    yield out
                    out, room = [], 1 << max(0, length.bit_length() - 1)


def pack(examples: DataFrame, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, cut: bool = True, model: str = MODEL) -> DataFrame:
    """Pieces (doc_id, start, length, ids, loss, doc_tokens, sequence_id, offset) of the examples (doc_id, texts, bears).

    An example's identifiers are those of its texts in order, then END; the tokens of the texts whose `bears` is true
    bear loss, END as the last text does. A sequence has at most `tokens` tokens, `segments` pieces and `loss` tokens
    that bear loss. ids: little-endian, four bytes each. Examples too long for a sequence are cut into such as fit;
    others are cut only with `cut`. Then a sequence lacks fewer than LEAST tokens or its length is a power of two.
    Each partition is packed by itself, a pool at a time, so nothing is shuffled and no task holds more than a pool and
    a batch; a task that runs again makes the same pieces, and sequence_id has the partition's number in front.

    Null or no texts give END alone; empty tables give no rows; repeated rows and rows without doc_id are examples like
    any other. Null `bears` count as false. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, packer = encoder(model), Packer(tokens, segments, loss, cut)
        first, k = TaskContext.get().partitionId() << 36, 0
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split(" ")[0] for x in SCHEMA.split(", ")])
            rows.clear()
            return made

        def place(sequences: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal k
            for sequence in sequences:
                offset = 0
                for key, start, ids, bears, total in sequence:
                    rows.append((key, start, len(ids), ids.astype("<u4").tobytes(), len(ids) if bears is None else int(bears.sum()), total, first + k, offset))
                    offset += len(ids)
                k += 1
                if len(rows) >= 1000:
                    yield out()

        for batch in batches:
            keys, texts, bears = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            count = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
            flat, flags = texts.flatten().fill_null(""), np.array(bears.flatten().fill_null(False).to_numpy(zero_copy_only=False), bool)
            upto = np.concatenate(([0], np.cumsum(count)))
            chars = np.concatenate(([0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False))))[upto]
            cuts = [0, *(np.flatnonzero(np.diff(chars // CHARS)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                ids, ends = code.encode(flat.slice(upto[s], upto[e] - upto[s])) if upto[e] > upto[s] else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
                ends = np.concatenate(([0], ends))
                for i in range(s, e):
                    a, b = int(upto[i] - upto[s]), int(upto[i + 1] - upto[s])
                    own, size, mask = np.append(ids[ends[a] : ends[b]], np.uint32(END)), np.diff(ends[a : b + 1]), None
                    if not (flag := flags[upto[i] : upto[i + 1]]).all() or not len(flag):
                        mask = np.append(np.repeat(flag, size), bool(len(flag) and flag[-1]))
                    yield from place(packer.add(keys[i], own, mask))
                    if packer.full():
                        yield from place(packer.pack(False))
        yield from place(packer.pack(True))
        if rows:
            yield out()

    return examples.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("texts").cast("array<string>").alias("texts"), F.col("bears").cast("array<boolean>").alias("bears")).mapInArrow(run, SCHEMA)


def documents(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) as examples all of whose tokens bear loss."""
    return docs.select("doc_id", F.array(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("texts"), F.array(F.lit(True)).alias("bears"))


def chats(turns: DataFrame, answers: str = "assistant") -> DataFrame:
    """Conversations (conv_id, turn, role, text) as examples by conv_id: the turns' texts in order, of which those by `answers` bear loss."""
    turn = F.struct("turn", "role", "text")
    told = turns.groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return told.select("doc_id", F.col("t.text").alias("texts"), F.transform("t", lambda x: F.coalesce(x["role"] == answers, F.lit(False))).alias("bears"))
