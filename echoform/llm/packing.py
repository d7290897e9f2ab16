"""Packing by vector bin packing.

An example is a vector (tokens, segments, loss-bearing tokens). Sequences are filled one
after another by the dot-product heuristic: of the waiting examples that fit in every
dimension, the one whose vector, as shares of the limits, has the largest dot product
with the room left. A gap no whole example fits may be filled with the head of one, its
tail waiting on. Packing is local to a partition, with a bounded buffer of examples:
no shuffle, and at most one poorly filled sequence a partition.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from echoform.llm.common import bound_batches, release

#: Texts are encoded in blocks of about BLOCK bytes; at least one text each.
END_ID, CACHE_WORDS, BUFFER_TOKENS, BLOCK = 2, 900_000, 2_000_000, 8 << 20
_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


@dataclass(frozen=True)
class Limits:
    """Per sequence: tokens, segments, loss-bearing tokens. Gaps under ``min_cut`` tokens stay padding."""

    tokens: int = 4096
    segments: int = 1024
    loss: int = 4096
    min_cut: int = 8


#: ASCII punctuation but for apostrophes, which open words of the vocabulary's pattern.
TRAILING = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != ord("'"))
END = np.array([END_ID], "<u4").tobytes()


def ragged(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices pool[start : start + length], one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(pool)) < 2**31 else np.int64
    at = np.repeat((starts - ends + lengths).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return pool[at]


class Tokenizer:
    """Ids of blocks of texts, by the tokenizers library, each kind of word once.

    Texts are cut at white space, and the chunks numbered, by Arrow. Letters with trailing
    punctuation, the common case, are two words of the vocabulary's pattern: many such
    letters are encoded in one text and cut apart after the ids that end a word. Wherever
    that gives another number of words than went in, and for all other chunks, each is
    encoded by itself. Words are remembered, by number, from block to block."""

    def __init__(self, path: str, most_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.tok = Library.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.most_words = most_words
        self.forget()

    def forget(self) -> None:
        """Words are numbered from 0, the empty one; their ids lie in the pool, one after another."""
        self.words: dict[str, int] = {"": 0}
        self.pool, self.lengths = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _each(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(words), 20_000):
            ids = [e.ids for e in self.tok.encode_batch(words[i : i + 20_000], add_special_tokens=False)]
            yield np.array([x for e in ids for x in e], "<u4"), np.array([len(e) for e in ids], np.int64)

    def _together(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or (len(ids) and stops[-1] != len(ids)):
                yield from self._each(part)
            else:
                yield ids, np.diff(stops, prepend=0)

    def numbers(self, words: list[str], encode: Callable[[list[str]], Iterator[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
        """The words' numbers; new ones are encoded first."""
        known = self.words
        fresh = [w for w in words if w not in known]
        if fresh:
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            parts = list(encode(fresh))
            self.pool = np.concatenate([self.pool, *[p for p, _ in parts]])
            self.lengths = np.concatenate([self.lengths, *[n for _, n in parts]])
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))

    def kinds(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per chunk, the numbers of its letters and its trailing punctuation, or of the whole and 0."""
        cores = pc.ascii_rtrim(chunks, characters=TRAILING)
        #: The only letter that is no longer one letter in lower case is U+0130.
        plain = pc.and_not(pc.utf8_is_alpha(cores), pc.match_substring(cores, "\u0130"))
        shaped = plain.to_numpy(zero_copy_only=False)
        first, second = np.zeros(len(chunks), np.int32), np.zeros(len(chunks), np.int32)
        if shaped.any():
            letters = pc.ascii_lower(cores.filter(plain)).dictionary_encode()
            first[shaped] = self.numbers(letters.dictionary.to_pylist(), self._together)[letters.indices.to_numpy()]
        if not shaped.all():
            first[~shaped] = self.numbers(chunks.filter(pc.invert(plain)).to_pylist(), self._each)
        extra = np.where(shaped, pc.binary_length(chunks).to_numpy() - pc.binary_length(cores).to_numpy(), 0)
        for n in np.unique(extra[extra > 0]).tolist():  # ASCII: bytes are characters
            at = np.flatnonzero(extra == n)
            tails = pc.utf8_slice_codeunits(chunks.take(pa.array(at)), start=-n).dictionary_encode()
            second[at] = self.numbers(tails.dictionary.to_pylist(), self._each)[tails.indices.to_numpy()]
        return first, second

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts one after another, each with END_ID last; ids per text."""
        if len(self.words) > self.most_words:
            self.forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        every = split.flatten().dictionary_encode()
        first, second = self.kinds(every.dictionary)
        starts, n = np.cumsum(self.lengths) - self.lengths, self.lengths
        both = np.stack([first, second], 1).ravel()
        pool, size = np.append(ragged(self.pool, starts[both], n[both]), np.uint32(END_ID)), np.append(n[first] + n[second], 1).astype(np.int32)
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        at = np.insert(every.indices.to_numpy(), bounds[1:], len(every.dictionary))
        size_at = size[at]
        ids = ragged(pool, (np.cumsum(size) - size)[at], size_at)
        ends = np.cumsum(size_at)[bounds[1:] + np.arange(len(texts))] if len(texts) else np.empty(0, np.int64)
        return ids.astype("<u4", copy=False), np.diff(ends, prepend=0)


@lru_cache(maxsize=2)
def tokenizer(path: str, most_words: int = CACHE_WORDS) -> Tokenizer:
    return Tokenizer(path, most_words)


class Packer:
    """Packs a stream of examples; ``rows`` collects finished pieces."""

    def __init__(self, limits: Limits, first_id: int):
        self.limits, self.next_id = limits, first_id
        self.items: list[list] = []  # doc_id, start, length, ids, loss-bearing
        self.waiting = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes, loss: bool = True) -> None:
        n, at = len(ids) // 4, 0
        cap = min(self.limits.tokens, self.limits.loss) if loss else self.limits.tokens
        while n - at >= cap:
            self.emit([[doc_id, at, cap, ids, loss]])
            at += cap
        if at < n:
            self.items.append([doc_id, at, n - at, ids, loss])
            self.waiting += n - at
        if self.waiting >= BUFFER_TOKENS:
            self.flush(False)

    def emit(self, members: list[list]) -> None:
        offset = 0
        for doc_id, start, n, ids, _ in members:
            self.rows.append((doc_id, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, self.next_id, offset))
            offset += n
        self.next_id += 1

    def flush(self, final: bool) -> None:
        """Fill sequences from the waiting examples; the last, unless final, waits on."""
        lim, items = self.limits, self.items
        size = np.array([x[2] for x in items], np.int64)
        loss = np.array([x[2] if x[4] else 0 for x in items], np.int64)
        live = np.ones(len(items), bool)
        left = len(items)
        while left:
            room, segs, room_loss, members = lim.tokens, lim.segments, lim.loss, []
            while segs and left:
                fits = live & (size <= room) & (loss <= room_loss)
                value = size * (room / lim.tokens**2) + loss * (room_loss / lim.loss**2) + segs / lim.segments**2
                i = int(np.argmax(np.where(fits, value, -1.0)))
                if not fits[i]:
                    break
                members.append(items[i])
                live[i] = False
                left -= 1
                room, segs, room_loss = room - int(size[i]), segs - 1, room_loss - int(loss[i])
            if room >= lim.min_cut and segs and left:  # every waiting example is larger than a gap: cut the largest
                i = int(np.argmax(np.where(live, size, -1)))
                gap = min(room, room_loss) if items[i][4] else room
                if lim.min_cut <= gap < size[i]:
                    d, start, n, ids, bears = items[i]
                    members.append([d, start, gap, ids, bears])
                    items[i] = [d, start + gap, n - gap, ids, bears]
                    size[i] -= gap
                    loss[i] -= gap if bears else 0
            if not left and not final:
                self.items, self.waiting = members, sum(x[2] for x in members)
                return
            self.emit(members)
        self.items, self.waiting = [], 0


def blocks(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches joined until they hold ``block`` bytes."""
    have, size = [], 0
    for b in batches:
        have.append(b)
        size += b.nbytes
        if size >= block:
            yield pa.concat_batches(have)
            have, size = [], 0
    if have:
        yield pa.concat_batches(have)


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), loss: str | None = None, most_words: int = CACHE_WORDS, lasting: bool = True, block: int = BLOCK) -> DataFrame:  # noqa: B008
    """Pack rows (doc_id, text) into sequences; one row per piece: see ``_OUT``.

    ``loss`` may name a boolean column that tells which rows' tokens bear loss (null:
    no); without it all do. Null and empty texts are the single END_ID. Each id lies in
    exactly one piece; long texts are cut at the limit. A worker remembers the ids of up
    to ``most_words`` words, for its next tasks too unless ``lasting`` is false, and holds
    about ``block`` bytes of texts at once. Sequence ids carry the partition
    number in their upper bits. Extra columns are ignored, repeated rows packed each, null
    ids kept; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, tok = Packer(limits, TaskContext.get().partitionId() << 33), tokenizer(path, most_words)

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.rows, strict=True)) or [()] * len(_NAMES)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_NAMES)

        for b in blocks(batches, block):
            ids, lengths = tok(b.column(1))
            bears = b.column(2).to_pylist() if loss else [True] * b.num_rows
            at = 0
            for d, n, x in zip(b.column(0).to_pylist(), lengths.tolist(), bears, strict=True):
                packer.add(d, ids[at : at + n].tobytes(), bool(x))
                at += n
            if len(packer.rows) > 5000:
                yield out()
        packer.flush(True)
        yield out()
        if not lasting:
            tok.forget()
            release()

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text", *([loss] if loss else [])).mapInArrow(run, _OUT)
