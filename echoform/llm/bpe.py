"""BPE encoding and decoding with a contiguous rank array per word.

A word's parts and the ranks of adjacent parts lie in two short arrays; the minimum
rank is found by scanning, its boundary deleted, and the two neighbouring ranks
refreshed. Words longer than ``SHORT`` bytes use a heap over linked parts, so that a
very long word costs n log n. Encoded words are kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from echoform.llm.common import bound_batches, widened

SHORT, CACHE_WORDS = 96, 400_000
#: The white space of the vocabulary's pattern, and that pattern.
WS = "\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
#: Where single spaces and single line ends are not the only white space, or stand at an end.
_UNEVEN = regex.compile(rf"[{WS}][{WS}]|^[{WS}]|[{WS}]\Z|(?![ \n])[{WS}]")
_NONE = 1 << 60


def byte_chars() -> list[str]:
    """The printable stand-in of each byte, by the byte-level rule: printable Latin-1
    bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


class Codec:
    """Encoder and decoder of a byte-level BPE vocabulary file (JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        byte_of = {c: i for i, c in enumerate(chars)}
        self.first = [vocab[c] for c in chars]
        self.merges = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, tuple[int, ...]] = {}

    def merge_short(self, ids: list[int]) -> list[int]:
        merges = self.merges
        ranks = [merges.get(p, (_NONE,))[0] for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            ids[i] = merges[ids[i], ids[i + 1]][1]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merges.get((ids[i - 1], ids[i]), (_NONE,))[0]
            if i < len(ranks):
                ranks[i] = merges.get((ids[i], ids[i + 1]), (_NONE,))[0]
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        nxt, prv, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = merges[a, b][1], False, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for x in (prv[i], i):
                if x >= 0 and nxt[x] >= 0 and (m := merges.get((ids[x], ids[nxt[x]]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[nxt[x]]))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def word(self, w: str) -> tuple[int, ...]:
        ids = [self.first[b] for b in w.encode()]
        return tuple(self.merge_short(ids) if len(ids) <= SHORT else self.merge_long(ids))

    def chunk(self, c: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(self.word(w) for w in self.split.findall(c)))

    def _plain(self, text: str) -> list[int]:
        known = self.words
        if _UNEVEN.search(text):
            parts = self.split.findall(text)
        else:  # cuts before single spaces and around single line ends fall between words of the pattern
            parts = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if "\0" not in text else self.split.findall(text)
        for c in set(parts).difference(known):
            if len(known) >= CACHE_WORDS:
                known.clear()
                break
            known[c] = self.chunk(c)
        try:
            return list(chain.from_iterable(map(known.__getitem__, parts)))
        except KeyError:
            return list(chain.from_iterable(known.get(c) or self.chunk(c) for c in parts))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array<int>) to docs; an existing column of that name is replaced.
    Null and empty texts give an empty array."""
    docs = docs.drop("ids")
    schema = widened(docs, "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = pa.array([c.encode(t) for t in b.column(text).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (string) to docs with an ids column; null ids give an empty text."""
    docs = docs.drop("decoded")
    schema = widened(docs, "decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = pa.array([c.decode(x or []) for x in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, "decoded"])

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: (doc_id, n_tokens, ids_sha256, decoded_sha256). One narrow pass:
    the ids never leave the worker. Null texts count as empty, null ids stay null; repeated
    rows keep a row each; extra columns are ignored; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sha, names = hashlib.sha256, c.text_of.__getitem__
        for b in batches:
            n, h, d = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py())
                n.append(len(ids))
                h.append(sha(",".join(map(names, ids)).encode()).hexdigest())
                d.append(sha(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
