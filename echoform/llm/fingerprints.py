"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes closes a chunk wherever its low bits are all
ones; each chunk gives one of 64 signature letters. The block size (bytes a chunk, on
average) follows from the text's length and is halved while a signature would have
fewer than half its letters, or doubled while boundaries are too many for the letters
and not too few at twice the size. Of boundaries that are too many still (repeated
lines) every 2nd, 4th and so on is used, and the size counts so much more, so that the
letters span the whole text. A fingerprint holds the signatures at
that size and at twice that size: ``size:signature:signature2``. Two fingerprints are
compared at a block size both have, by the edit distance of their signatures (a
substitution counts as a deletion and an insertion), computed bit-parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoform.llm.common import bound_batches, widened

WINDOW, MAX_CHUNKS, MIN_BLOCK, SHARED_RUN = 7, 64, 1, 3
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_MULT = np.array([pow(0x9E3779B1, k, 1 << 32) for k in range(1, WINDOW + 1)], np.uint32)
ROWS_PER_RANGE, MAX_RANGES = 2000, 100_000


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last WINDOW bytes up to each position; bytes before the text are 0."""
    x = data.astype(np.uint32) + np.uint32(1)
    h = x * _MULT[0]
    for k in range(1, min(WINDOW, len(x))):
        h[k:] += x[:-k] * _MULT[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def _signature(h: np.ndarray, ends: np.ndarray) -> str:
    """One letter per chunk; the last takes what is left of the whole text."""
    ends = ends[: MAX_CHUNKS - 1]
    starts = np.concatenate(([0], ends + 1))
    starts = starts[starts < len(h)]
    sums = np.add.reduceat(h, starts, dtype=np.uint32)
    return LETTERS[((sums * np.uint32(0x9E3779B1)) >> np.uint32(26))].tobytes().decode()


def _ends(h: np.ndarray, block: int) -> np.ndarray:
    return np.flatnonzero((h & np.uint32(block - 1)) == block - 1)


def _chunks(h: np.ndarray, ends: np.ndarray) -> int:
    """Chunks that ends cut; a boundary at the last byte leaves nothing after it."""
    return int(np.searchsorted(ends, len(h) - 1)) + 1


def fingerprint(data: bytes) -> str:
    """Fingerprint of a text's UTF-8 bytes; the empty text gives ``1::``."""
    if not data:
        return f"{MIN_BLOCK}::"
    h, block = rolling(np.frombuffer(data, np.uint8)), MIN_BLOCK
    while block * MAX_CHUNKS * 3 // 4 < len(data):
        block *= 2
    ends = _ends(h, block)
    while block > MIN_BLOCK and _chunks(h, ends) < MAX_CHUNKS // 2:
        block //= 2
        ends = _ends(h, block)
    while len(ends) >= MAX_CHUNKS and _chunks(h, fewer := _ends(h, 2 * block)) >= MAX_CHUNKS // 2:
        block, ends = 2 * block, fewer
    step = 1
    while len(ends) >= MAX_CHUNKS * step:
        step *= 2
    wide = _ends(h, 2 * block)
    if step > 1 or _chunks(h, wide) < MAX_CHUNKS // 4:
        wide = ends[2 * step - 1 :: 2 * step]
    return f"{block * step}:{_signature(h, ends[step - 1 :: step])}:{_signature(h, wide)}"


def _lcs(a: list[str], b: list[str]) -> np.ndarray:
    """Longest common subsequences of pairs of strings of at most 64 letters, all at once."""
    n = len(a)
    code = {chr(c): i for i, c in enumerate(LETTERS)}
    masks = np.zeros((n, 64), np.uint64)
    fixed = np.full((n, MAX_CHUNKS), -1, np.int8)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        for j, c in enumerate(x):
            masks[i, code[c]] |= np.uint64(1 << j)
        fixed[i, : len(y)] = [code[c] for c in y]
    v, row = np.full(n, ~np.uint64(0)), np.arange(n)
    for j in range(max((len(y) for y in b), default=0)):
        c = fixed[:, j]
        u = np.where(c >= 0, v & masks[row, np.maximum(c, 0)], np.uint64(0))
        v = np.where(c >= 0, (v + u) | (v - u), v)
    lengths = np.fromiter((len(x) for x in a), np.int64, n)
    used = np.where(lengths >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(lengths, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~v & used).astype(np.int64)


def _runs(s: str) -> set[str]:
    return {s[i : i + SHARED_RUN] for i in range(len(s) - SHARED_RUN + 1)}


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 per pair of fingerprints: 1 for equal ones, 0 where no block size is
    shared or no run of three letters is; else 1 - edit distance / letters."""
    out, jobs = np.zeros(len(left)), []
    for i, (f, g) in enumerate(zip(left, right, strict=True)):
        if f == g:
            out[i] = 1.0
            continue
        (b, f1, f2), (c, g1, g2) = f.split(":"), g.split(":")
        b, c = int(b), int(c)
        pairs = [(f1, g1), (f2, g2)] if b == c else [(f2, g1)] if 2 * b == c else [(f1, g2)] if b == 2 * c else []
        for x, y in pairs:
            if x and y and (not _runs(x).isdisjoint(_runs(y))):
                jobs.append((i, x, y))
    if jobs:
        where, xs, ys = zip(*jobs, strict=True)
        both = np.array([len(x) + len(y) for x, y in zip(xs, ys, strict=True)])
        np.maximum.at(out, np.array(where), np.minimum(2 * _lcs(list(xs), list(ys)) / both, 1 - 1e-6))
    return out


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``fingerprint`` to docs (an existing column of that name is replaced); null
    texts count as empty. One narrow pass."""
    docs = docs.drop("fingerprint")
    schema = widened(docs, "fingerprint string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array([fingerprint((t or "").encode()) for t in b.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "fingerprint"])

    return docs.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last half of text (rounded down) replaced by the first as many letters of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _judge(texts: list[tuple[int, str]], keep: int) -> pa.RecordBatch:
    """Rows for the first ``keep`` texts; the next of each is the one after it."""
    prints = [fingerprint(t.encode()) for _, t in texts]
    changed = [edited(texts[i][1], texts[i + 1][1]).encode() for i in range(keep)]
    theirs = [prints[i] if c == texts[i][1].encode() else fingerprint(c) for i, c in enumerate(changed)]
    cols = [
        pa.array([d for d, _ in texts[:keep]], pa.int64()), pa.array([len(t) for _, t in texts[:keep]], pa.int64()),
        pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()), pa.array(prints[:keep], pa.string()), pa.array(theirs, pa.string()),
        pa.array(likeness(prints[:keep], theirs), pa.float64()), pa.array(likeness(prints[:keep], prints[1 : keep + 1]), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=_NAMES)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and id; a range's last row is the first of the next range, there for its text alone."""
    held: list[tuple[int, str]] = []
    last = None
    for b in batches:
        for r, halo, d, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if r != last:
                held, last = [], r
            held.append((d, t or ""))
            if halo or len(held) > 512:
                yield _judge(held, len(held) - 1)
                held = [] if halo else held[-1:]


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text, and compare: see ``_OUT``.

    Documents follow each other by ascending doc_id (nulls first, ties by text); the
    first follows the last, and a lone document follows itself. Null texts count as
    empty; extra columns are ignored. Rows are dealt by ranges of doc_id, so that texts
    move once; each range also gets a copy of the next range's first row. Aside are
    kept only the ranges' borders and first ids, one in ROWS_PER_RANGE rows and at
    most MAX_RANGES. Empty tables give no rows."""
    spark = docs.sparkSession
    bound_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = slim.count()
    ranges = max(1, min(MAX_RANGES, n // ROWS_PER_RANGE))
    quantiles = slim.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    cuts = np.array(sorted({int(c) for c in quantiles}), np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(cuts, ids[known].astype("int64"), side="right")
        return pd.Series(out)

    placed = slim.withColumn("r", range_of("doc_id"))
    firsts = sorted(placed.groupBy("r").agg(F.min(F.struct("doc_id")).alias("k")).select("r", "k.doc_id").collect(), key=lambda x: x.r)
    lead = spark.createDataFrame([(x.r, x.doc_id, firsts[i - 1].r) for i, x in enumerate(firsts)], "r int, first long, prev int")
    head = (
        placed.join(F.broadcast(lead), "r").where(F.col("doc_id").eqNullSafe(F.col("first")))  # at most MAX_RANGES rows
        .groupBy("prev").agg(F.min(F.struct("doc_id", "text")).alias("k"))
        .select(F.col("prev").alias("r"), F.lit(1).alias("halo"), "k.doc_id", "k.text")
    )
    rows = placed.select("r", F.lit(0).alias("halo"), "doc_id", "text").unionByName(head)
    return rows.repartition(max(len(firsts), 1), "r").sortWithinPartitions("r", "halo", "doc_id", "text").mapInArrow(_walk, _OUT)
