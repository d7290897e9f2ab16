"""N-gram Jaccard join by parity sketches.

A set of tokens (64-bit hashes of word shingles) is folded into a parity sketch: a token
flips the bit it hashes to, so the XOR of two sketches is the sketch of the symmetric
difference and their Hamming distance never exceeds its size. At similarity 3/4 the
difference of sets of a <= b tokens is at most (a + b) / 7, so at most a / 3 and 2 b / 7.

Candidates come from a pigeonhole join per size band: tokens are dealt to pieces, more
non-empty ones than there can be differing tokens, and each piece is XOR-folded to one
key; two linked sets agree in a non-empty piece. Keys travel packed, with the classes of
a row numbered in a dictionary, in one shuffle of as many parts as the texts' bytes ask
for. Keys of more than ``HOT`` sets link their members to one centre only. A set that
keeps more cold pieces than it can have differing tokens is still found by those; so
only pairs of two sets that do not ("weak") can be missed, and the weak members of a hot
key that are of different components are compared by sketch, in square blocks dealt
over tasks: first the nearest pair of each two components, then, where that is no link,
all. Candidates pass tests of sizes, of short sketches, which are what a pair carries,
and of whole ones, then whole sets of 64-bit tokens are intersected.

Equal sets are one class throughout; links between classes make the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoform.llm.common import Scratch, components, release

WORDS, HOT, LOCAL_HOT, CHUNK_KEYS, CACHE_WORDS = 5, 16, 64, 800_000, 200_000
#: Keys of a part that meet at once, about: a power of two.
SLICE_KEYS = 1 << 20
#: Bytes of texts a part of the key shuffle stands for; its keys take about twice that.
PART_BYTES = 48 << 20
#: A side of a square block of weak members: bytes of sketches and rows; pairs compared with one copy of a set.
SIDE_BYTES, SIDE_ROWS, PAIRS_A_COPY = 4 << 20, 8192, 128
#: Bands from so many tokens down have a piece per token: few tokens could share pieces by chance.
SINGLE = 32
#: Lists of ids up to so many rows (8 bytes each) are broadcast; longer ones are shuffled.
BROADCAST_ROWS = 1_000_000
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_ROW = "part int, kind int, a long, b long, n int, m int, k int, w binary, x binary, y binary, z binary"
_ROW_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_ROW_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in _ROW.split(", ")]
DOC, KEYS, PAIRS, MEMBERS, COUNTS = range(5)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def tokens(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text: A-Z
    lower-cased, words cut at ASCII white space; fewer words: the sequence as one; none: empty."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(h) < k:
        return _mix(np.array([xxhash.xxh64_intdigest(h.tobytes())], np.uint64))
    n = len(h) - k + 1
    s = h[:n] * _MULT[0]
    for j in range(1, k):
        s += h[j : j + n] * _MULT[j % len(_MULT)]
        s = (s << np.uint64(7)) | (s >> np.uint64(57))
    return np.unique(_mix(s))


def bands(limit: int = 1 << 40) -> np.ndarray:
    """Lower ends of the size bands: a set's possible partners lie in its band or a next one."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, -(-4 * out[-1] // 3)))
    return np.array(out, np.int64)


_BANDS = bands()


def sketch(s: np.ndarray) -> bytes:
    """Parity sketch of at least four times as many bits as tokens, a power of two from
    256 on: so long that few flips cancel, and pairs well under the threshold show it."""
    bits = 256
    while bits < 4 * len(s):
        bits *= 2
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(x: np.ndarray, size: int) -> np.ndarray:
    """XOR sketches (rows of bytes) down to ``size`` bytes."""
    while x.shape[1] > size:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def short(x: bytes) -> bytes:
    """A sketch folded to a quarter, 256 bits at least: it still rules out what is far from a link."""
    return fold(np.frombuffer(x, np.uint8)[None, :], max(32, len(x) // 4)).tobytes()


def may_link(a: bytes, b: bytes, na: int, nb: int) -> bool:
    """False only if the sketches or the sizes rule a link out."""
    if 4 * min(na, nb) < 3 * max(na, nb):
        return False
    x, y = np.frombuffer(a, np.uint8)[None, :], np.frombuffer(b, np.uint8)[None, :]
    size = min(x.shape[1], y.shape[1])
    return 7 * int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= na + nb


def piece_keys(s: np.ndarray) -> tuple[np.ndarray, int]:
    """(64-bit keys of the non-empty pieces: own band's, then those of the band below; how
    many are its own band's)."""
    band = int(np.searchsorted(_BANDS, len(s), side="right")) - 1
    out = []
    for j in (band, band - 1):
        if j < 0:
            continue
        m = int(-(-6 * _BANDS[j] // 10)) + 8 if _BANDS[j] > SINGLE else 1 << 31
        p = ((s >> np.uint64(24)) % np.uint64(m)).astype(np.uint32)
        order = np.argsort(p, kind="stable")
        p = p[order]
        at = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        x = np.bitwise_xor.reduceat(s[order], at)
        out.append(_mix(x ^ (p[at].astype(np.uint64) * _MULT[1]) ^ np.uint64((j + 1) * int(_MULT[2]) & 0xFFFFFFFFFFFFFFFF)))
    return np.concatenate(out), len(out[0])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_ROW_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ROW_TYPES, strict=True)], names=_ROW_NAMES)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of a sorted array."""
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return at, np.diff(np.r_[at, len(keys)])


class _Emitter:
    """Collects piece keys of a chunk of sets and packs them by part."""

    def __init__(self, parts: int):
        self.parts, self.seen = parts, set()
        self.clear()

    def clear(self) -> None:
        self.keys, self.own, self.names, self.sizes, self.n = [], [], [], [], 0

    def add(self, s: np.ndarray, cls: int) -> tuple[int, int]:
        """Pieces of the set's own band and of the band below; none for a class seen before."""
        if cls in self.seen:
            return 0, 0
        keys, n_own = piece_keys(s)
        if len(self.seen) > 1_000_000:
            self.seen.clear()
        self.seen.add(cls)
        self.keys.append(keys)
        self.names.append(cls)
        self.sizes.append(len(keys))
        self.own.append(np.arange(len(keys)) < n_own)
        self.n += len(keys)
        return n_own, len(keys) - n_own

    def flush(self) -> Iterator[tuple]:
        """KEYS, MEMBERS, PAIRS and COUNTS rows of the chunk. A key of many sets here is
        hot: its first set travels on for it, with a mark, and the others are its members."""
        if not self.n:
            return
        keys, own, names = np.concatenate(self.keys), np.concatenate(self.own), np.array(self.names, np.int64)
        cls = np.repeat(np.arange(len(names), dtype=np.int32), self.sizes)
        self.clear()
        code = (keys >> np.uint64(32)) % np.uint64(self.parts) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)
        order = np.argsort(code, kind="stable")
        code, cls, own = code[order], cls[order], own[order]
        at, n = _groups(code)
        hot, marks = np.repeat(n > LOCAL_HOT, n), at[n > LOCAL_HOT]
        if len(marks):
            yield from _pair_rows(names, _star_pairs(code, cls, hot, len(names)))
            yield _counts(names, *(np.bincount(cls[hot & o], minlength=len(names)) for o in (own, ~own)))
        keep = ~hot
        keep[marks] = True
        marked = np.zeros(len(code), bool)
        marked[marks] = True
        low, part = code.astype("<u4"), (code >> np.uint64(32)).astype(np.int64)
        for lo, n in zip(*_groups(part), strict=True):
            here = slice(lo, lo + n)
            p, h, k = int(part[lo]), hot[here], keep[here]
            if h.any():
                yield _members(p, low[here][h], names[cls[here][h]], own[here][h])
            o = np.argsort(~own[here][k], kind="stable")
            used, at_dict = np.unique(cls[here][k][o], return_inverse=True)
            yield p, KEYS, None, None, int(own[here][k].sum()), 0, 0, low[here][k][o].tobytes(), names[used].tobytes(), at_dict.astype("<u2" if len(used) <= 1 << 16 else "<u4").tobytes(), low[here][marked[here]].tobytes()


def _members(part: int, low: np.ndarray, names: np.ndarray, own: np.ndarray) -> tuple:
    o = np.argsort(~own, kind="stable")
    return part, MEMBERS, None, None, int(own.sum()), 0, 0, low[o].astype("<u4").tobytes(), names[o].astype("<i8").tobytes(), None, None


def _star_pairs(code: np.ndarray, cls: np.ndarray, hot: np.ndarray, m: int) -> np.ndarray:
    """For the entries of hot keys (mask over entries sorted by key): pairs of each run's first class with the rest."""
    c = cls[hot].astype(np.int64)
    at, n = _groups(code[hot])
    return _pair_codes(np.repeat(c[at], n), c, m)


def _counts(names: np.ndarray, own: np.ndarray, below: np.ndarray) -> tuple:
    """How many hot keys of either band each class has."""
    who = np.flatnonzero(own + below)
    return 0, COUNTS, None, None, 0, 0, 0, names[who].tobytes(), own[who].astype("<i4").tobytes(), below[who].astype("<i4").tobytes(), None


def _pair_codes(i: np.ndarray, j: np.ndarray, m: int) -> np.ndarray:
    """Distinct pairs of m classes, the smaller first, a number each."""
    return np.unique(np.minimum(i, j).astype(np.uint64) * np.uint64(m) + np.maximum(i, j).astype(np.uint64))


def _pair_rows(names: np.ndarray, code: np.ndarray) -> Iterator[tuple]:
    """PAIRS rows of the pairs of different classes, the smaller first."""
    m = np.uint64(len(names))
    for lo in range(0, len(code), 100_000):
        c = code[lo : lo + 100_000]
        a, b = names[(c // m).astype(np.int64)], names[(c % m).astype(np.int64)]
        pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b]
        if len(pairs):
            yield 0, PAIRS, None, None, 0, 0, 0, None, pairs.astype("<i8").tobytes(), None, None


def _spread(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Emitter(parts)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                rows = []
                for doc_id, text in zip(*(c.to_pylist() for c in b.slice(lo, 1000).columns), strict=True):
                    s = tokens(text)
                    cls = xxhash.xxh64_intdigest(s.tobytes()) >> 1 if len(s) else None
                    m, k = out.add(s, cls) if len(s) else (0, 0)
                    rows.append(((doc_id or 0) % parts, DOC, doc_id, cls, len(s), m, k, None, sketch(s) if m else None, None, None))
                    if out.n >= CHUNK_KEYS:
                        rows += out.flush()
                yield _rows(rows)
        yield _rows(list(out.flush()))
        _HASHES.clear()
        release()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: keys meet, candidates leave; other rows pass."""
    held: list[tuple] = []
    last = None
    for b in batches:
        part, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
        rest = b.filter(pa.array(kind != KEYS))
        if rest.num_rows:
            yield rest
        keyed = b.filter(pa.array(kind == KEYS))
        for p, *row in zip(part[kind == KEYS].tolist(), *(keyed.column(i).to_pylist() for i in (4, 7, 8, 9, 10)), strict=True):
            if p != last and held:
                yield from (_rows([r]) for r in _match(last, held))
                held = []
            last = p
            held.append(tuple(row))
    if held:
        yield from (_rows([r]) for r in _match(last, held))
    held = []
    release()


def _match(part: int, held: list[tuple]) -> Iterator[tuple]:
    """Candidates of one part: all pairs of a cold key, a star of a hot one. Keys meet in
    slices of about SLICE_KEYS, by their first bits; a row's own keys, and its others, are sorted."""
    dicts = [np.frombuffer(x, "<i8") for _, _, x, _, _ in held]
    names, dense = np.unique(np.concatenate(dicts), return_inverse=True)
    starts, m = np.cumsum([0, *map(len, dicts)]), len(names)
    marks = np.unique(np.concatenate([np.frombuffer(z, "<u4") for _, _, _, _, z in held]))
    slices = 1
    while slices * SLICE_KEYS < sum(len(w) for _, w, _, _, _ in held) // 4:
        slices *= 2
    edges = np.arange(1, slices, dtype=np.uint64) * np.uint64((1 << 32) // slices)
    rows = []
    for lo, (n, w, _, y, _) in zip(starts[:-1], held, strict=True):
        low, at = np.frombuffer(w, "<u4"), np.frombuffer(y, "<u2" if 2 * len(y) == len(w) else "<u4")
        for keys, places, own in ((low[:n], at[:n], 1), (low[n:], at[n:], 0)):
            rows.append((lo, keys, places, np.uint64(own), [0, *np.searchsorted(keys, edges.astype("<u4")).tolist(), len(keys)]))
    pairs, counts = np.empty(0, np.uint64), [np.zeros(m, np.int64), np.zeros(m, np.int64)]
    for i in range(slices):
        v = np.unique(np.concatenate([  # copies of a class from several tasks go
            keys[c[i] : c[i + 1]].astype(np.uint64) << np.uint64(32) | dense[lo + places[c[i] : c[i + 1]].astype(np.int64)].astype(np.uint64) << np.uint64(1) | own
            for lo, keys, places, own, c in rows
        ]))
        low, cls, own = (v >> np.uint64(32)).astype("<u4"), (v >> np.uint64(1) & np.uint64(0x7FFFFFFF)).astype(np.int64), (v & np.uint64(1)).astype(bool)
        at, n = _groups(low)
        many = (n > HOT) | np.isin(low[at], marks)
        hot = np.repeat(many, n)
        found = [pairs]
        if hot.any():
            found.append(_star_pairs(low, cls, hot, m))
            for total, of in zip(counts, (own, ~own), strict=True):
                total += np.bincount(cls[hot & of], minlength=m)
            yield _members(part, low[hot], names[cls[hot]], own[hot])
        for size in range(2, HOT + 1):  # all pairs of a cold key, all keys of one size at once
            at_size = at[(n == size) & ~many]
            if len(at_size):
                block = cls[at_size[:, None] + np.arange(size)]
                left, right = np.triu_indices(size, 1)
                found.append(_pair_codes(block[:, left].ravel(), block[:, right].ravel(), m))
        pairs = np.unique(np.concatenate(found))
    if any(c.any() for c in counts):
        yield _counts(names, *counts)
    yield from _pair_rows(names, pairs)


def _emit(columns: list[np.ndarray], names: list[str], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + rows]) for c in columns], names=names)


def _unpack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column(0).to_pylist():
            yield from _emit(list(np.frombuffer(x, "<i8").reshape(-1, 2).T), ["a", "b"])


def _unpack_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for p, n, w, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            low = np.frombuffer(w, "<u4").astype(np.int64)
            yield from _emit([np.int64(p) << 32 | low, np.frombuffer(x, "<i8"), np.arange(len(low)) < n], ["key", "cls", "own"])


def _unpack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield from _emit([np.frombuffer(w, "<i8"), np.frombuffer(x, "<i4"), np.frombuffer(y, "<i4")], ["cls", "own", "below"])


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is a sketch: plus the short one."""
    for b in batches:
        y = pa.array([short(x) for x in b.column(b.num_columns - 1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns, y], names=[*b.schema.names, "y"])


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs (a, b, na, nb, xa, xb) that the sketches allow."""
    for b in batches:
        keep = [may_link(*r) for r in zip(*(b.column(i).to_pylist() for i in (4, 5, 2, 3)), strict=True)]
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            s = [tokens(t).tobytes() for t in b.slice(lo, 1000).column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(x) >> 1 for x in s], pa.int64()), pa.array(s, pa.binary())], names=["cls", "s"])
    _HASHES.clear()
    release()


def links(base: np.ndarray, x: np.ndarray) -> bool:
    """Whether 100 * intersection >= 75 * union, for sorted distinct tokens."""
    at = np.minimum(base.searchsorted(x), len(base) - 1)
    i = int((base[at] == x).sum())
    return 100 * i >= 75 * (len(base) + len(x) - i)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, b, s) sorted by those: a set (b null), then its partners: the pairs that link."""
    base, of = None, None
    for b in batches:
        out = []
        for a, salt, other, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if other is None:
                base, of = np.frombuffer(s, np.uint64), (a, salt)
            elif of != (a, salt):
                raise ValueError(f"no tokens of class {a}")
            elif links(base, np.frombuffer(s, np.uint64)):
                out.append((a, other))
        yield _pair_batch(out)


def _cross(every: bool):
    """Rows (task, side, cls, comp, n, x) sorted by task: members of a hot key, one side
    of a square against the other (or one against itself), by size and sketch: pairs of
    different components that may link, all or the nearest of each two components."""
    def close(rows: list[tuple]) -> list[tuple[int, int]]:
        size = min(len(r[4]) for r in rows)
        side, cls, comp, n = (np.array(c) for c in list(zip(*rows, strict=True))[:4])
        x = np.concatenate([fold(np.frombuffer(r[4], np.uint8)[None, :], size) for r in rows]).view(np.uint64)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else left
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        out = set()
        for i in left:
            js = right[(comp[right] != comp[i]) & (4 * np.minimum(n[right], n[i]) >= 3 * np.maximum(n[right], n[i]))]
            if not len(js):
                continue
            d = np.bitwise_count(x[js] ^ x[i]).sum(axis=1, dtype=np.int64)
            near = 7 * d <= n[js] + n[i]
            for j, far in zip(js[near].tolist(), d[near].tolist(), strict=True):
                a, b = sorted((int(cls[i]), int(cls[j])))
                if every:
                    out.add((a, b))
                else:
                    both = (min(int(comp[i]), int(comp[j])), max(int(comp[i]), int(comp[j])))
                    best[both] = min(best.get(both, (far, a, b)), (far, a, b))
        return sorted(out) if every else [(a, b) for _, a, b in best.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for b in batches:
            for task, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if task != last:
                    if len(held) > 1:
                        yield _pair_batch(close(held))
                    held, last = [], task
                held.append(tuple(row))
        if len(held) > 1:
            yield _pair_batch(close(held))

    return run


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _squares(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (key, cls, comp, bytes) of the keys that hold several components, dealt to
    square blocks: plus task, side. The largest component of a key is never compared
    with itself, so its members travel once per block of the others."""
    by_comp = keyed.groupBy("key", "comp").agg(F.count("*").alias("k"), F.sum("bytes").alias("bytes"))
    of_key = by_comp.groupBy("key").agg(F.max(F.struct("k", "comp", "bytes")).alias("main"), F.sum("k").alias("k"), F.sum("bytes").alias("bytes"), F.count("*").alias("comps")).where("comps > 1")
    sides = lambda k, size: F.greatest(F.ceil(k / SIDE_ROWS), F.ceil(size / SIDE_BYTES), F.lit(1)).cast("int")
    open_keys = scratch.write(of_key.select(
        "key", F.col("main.comp").alias("main"), sides(F.col("main.k"), F.col("main.bytes")).alias("p_main"),
        sides(F.col("k") - F.col("main.k"), F.col("bytes") - F.col("main.bytes")).alias("p_other"),
    ))
    rows = keyed.join(open_keys, "key").withColumn("is_main", F.col("comp") == F.col("main"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("cls"), F.when(F.col("is_main"), F.col("p_main")).otherwise(F.col("p_other"))).cast("int"))

    def square(kind, p, q, side):
        return F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"), side.alias("side"))

    mine, zero, one = F.col("mine"), F.lit(0), F.lit(1)
    main = F.transform(F.sequence(zero, F.col("p_other") - 1), lambda i: square(0, i, mine, one))
    other = F.concat(
        F.transform(F.sequence(zero, F.col("p_main") - 1), lambda j: square(0, mine, j, zero)),
        F.transform(F.sequence(zero, F.col("p_other") - 1), lambda i: square(1, F.least(mine, i), F.greatest(mine, i), F.when(mine > i, one).otherwise(zero))),
    )
    rows = rows.withColumn("sq", F.explode(F.when(F.col("is_main"), main).otherwise(other)))
    return rows.select(F.xxhash64("key", "sq.kind", "sq.p", "sq.q").alias("task"), F.col("sq.side").alias("side"), "cls", "comp")


def _parts(docs: DataFrame) -> int:
    """Parts of the key shuffle: the session's number, or what the texts' bytes ask for."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links of similarity 3/4 or more;
    kept: the row's doc_id is that. Null, empty and blank texts have no shingles and link
    with nothing. Equal sets are linked whatever their texts. Repeated rows keep a row
    each. Extra columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = _parts(slim)
    met = scratch.write(slim.mapInArrow(_spread(parts), _ROW).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_meet, _ROW))
    rows = met.where(F.col("kind") == DOC).select(F.col("a").alias("doc_id"), F.col("b").alias("cls"), F.col("n").alias("n_shingles"), "m", "k", "x")
    classes = scratch.write(
        rows.where("cls is not null").groupBy("cls")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.max("m").alias("m"), F.max("k").alias("k"), F.first("x", ignorenulls=True).alias("x"))
        .mapInArrow(_shorten, "cls long, rep long, n int, m int, k int, x binary, y binary")
    )

    def side(of: DataFrame, name: str, *cols: str) -> DataFrame:
        return of.select(F.col("cls").alias(name), *(F.col(c).alias(c + name) for c in cols))

    def close(pairs: DataFrame) -> DataFrame:
        """Of class pairs (a, b) those that sizes and short sketches allow. Sizes are looked
        up first: then a pair carries a sketch only if they fit."""
        sized = pairs.join(side(classes, "a", "n"), "a").join(side(classes, "b", "n", "y"), "b").where(4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb"))
        return sized.join(side(classes, "a", "y"), "a").select("a", "b", "na", "nb", "ya", "yb").mapInArrow(_sift, "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of class pairs (a, b), a < b, those that link. Sketches of their classes only are
        dealt out. A set travels once per partner of a smaller class, and once per
        PAIRS_A_COPY partners of larger ones."""
        near = scratch.write(pairs)
        ids = scratch.write(near.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        few = scratch.write(classes.select("cls", "n", "x").join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "cls", "left_semi"))
        pairs = scratch.write(near.join(side(few, "a", "n", "x"), "a").join(side(few, "b", "n", "x"), "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_sift, "a long, b long"))
        scratch.drop(near, ids, few)
        wanted = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "rep"), "cls"))
        ids = wanted.select("rep").distinct()
        ids = F.broadcast(ids) if wanted.count() <= BROADCAST_ROWS else ids
        texts = slim.join(ids, slim.doc_id.eqNullSafe(ids.rep), "left_semi").select("text")
        sets = scratch.write(texts.mapInArrow(_sets, "cls long, s binary").join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]))
        copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("copies"))
        whole = copies.join(sets.withColumnRenamed("cls", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "s")
        salted = pairs.join(copies, "a").select("a", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"), "b")
        partners = salted.join(sets.withColumnRenamed("cls", "b"), "b").select("a", "salt", "b", "s")
        out = scratch.write(whole.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", "b").mapInArrow(_verify, "a long, b long"))
        scratch.drop(pairs, wanted, sets)
        return out

    packed = met.where(F.col("kind") == PAIRS).select("x").mapInArrow(_unpack_pairs, "a long, b long").distinct()
    linked = verified(close(packed))
    comp = components(linked.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)

    # Weak sets: too few cold pieces, in a band's scheme, for the pigeonhole to hold.
    counts = met.where(F.col("kind") == COUNTS).select("w", "x", "y").mapInArrow(_unpack_counts, "cls long, own int, below int").groupBy("cls").agg(F.sum("own").alias("own"), F.sum("below").alias("below"))
    weak = classes.join(counts, "cls").select(
        "cls", "n", (F.col("m") - F.col("own") <= F.floor(F.col("n") / 3)).alias("in_own"),
        ((F.col("k") > 0) & (F.col("k") - F.col("below") <= F.floor(2 * F.col("n") / 7))).alias("in_below"), "x",
    ).where("in_own or in_below")
    members = met.where(F.col("kind") == MEMBERS).select("part", "n", "w", "x").mapInArrow(_unpack_members, "key long, cls long, own boolean").distinct()
    weak = scratch.write(weak)
    if weak.limit(1).count():
        members = scratch.write(members.join(weak, "cls").where(F.when(F.col("own"), F.col("in_own")).otherwise(F.col("in_below"))).select("key", "cls", F.octet_length("x").alias("bytes")))
        open_to = None
        for every in (False, True):
            keyed = members.join(comp.withColumnRenamed("id", "cls"), "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("comp"), "bytes")
            keyed = keyed if open_to is None else keyed.join(open_to, "comp", "left_semi")
            blocks = _squares(keyed, scratch).join(weak.select("cls", "n", "x"), "cls").select("task", "side", "cls", "comp", "n", "x")
            found = scratch.write(blocks.repartition("task").sortWithinPartitions("task").mapInArrow(_cross(every), "a long, b long").distinct())
            more = verified(found)
            if more.limit(1).count():
                comp = components(comp.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v"))), scratch)
            # Components whose nearest members link are one by now; others are open to all their pairs.
            failed = found.join(more, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comp, "id", "left")
            open_to = scratch.write(failed.select(F.coalesce("component", "id").alias("comp")).distinct())
            if not open_to.limit(1).count():
                break
    labelled = classes.select("cls", "rep").join(comp.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = scratch.write(labelled.join(least, "component").select("cls", "component_id"))
    out = rows.select("doc_id", "n_shingles", "cls").join(final, "cls", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))
