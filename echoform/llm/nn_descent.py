"""Embedding near-duplicates by NN-descent.

Equal vectors of a label are one class. Each class has a code, the signs of CODE random
projections, whose Hamming distance tells the angle; codes, not vectors, travel. A first
neighbour graph comes from blocks of a few random orders of the codes. It is refined by
neighbours-of-neighbours joins: the neighbours of a vector, and those it is a neighbour
of, are compared with each other, and nearer ones enter their lists, until no near ones
do. Edges near the threshold are decided on the vectors themselves, in doubles.

A list full of near neighbours is saturated: it may hide links to other vectors with
saturated lists. Those lists are enlarged without bound, by cells: saturated vectors are
gathered around centres; cells, and pairs of cells, so close that they link as a whole
are only counted, and the members of other near pairs of cells are compared. Recall is audited against
all vectors on a sample drawn whatever was found for it, vectors of few links apart from
those of many; orders are doubled while it is short, until blocks would cost as much as
comparing everything, which is then done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoform.llm.common import Scratch, components, forest

THRESHOLD, NEIGHBOURS, REVERSE, BLOCK, ORDERS, ROUNDS = 0.98, 8, 6, 256, 4, 6
#: Bits of a code (whole 64-bit words); bits of it that an order sorts by.
CODE, ORDER_BITS = 256, 62
ANGLE = float(np.arccos(THRESHOLD))
#: Expected differing bits at the threshold and five deviations more: all that may link;
#: neighbours at more than 45 degrees do not enter lists.
NEAR = int(np.ceil(CODE * ANGLE / np.pi + 5 * np.sqrt(CODE * ANGLE / np.pi * (1 - ANGLE / np.pi))))
FLOOR, FAR = CODE // 4 + 4, CODE + 1
#: Classes audited, and more of them while fewer than AUDIT_FEW have few links.
AUDIT, AUDIT_MOST, AUDIT_FEW, RECALL = 4096, 16384, 128, 0.97
#: Saturated vectors of a component that a task gathers to cells, and of one of more than MANY parts;
#: cells, and vectors, a side of a square; radians of slack of angles.
PART, MANY, LARGE_PART, CELLS, SQUARE, SLACK = 256, 64, 2048, 2048, 512, 1e-4


def _rows(columns: list, names: str, kinds: str) -> pa.RecordBatch:
    """A batch of columns; kinds: a letter each: l(ong), i(nt), b(oolean), d(ouble), x (binary)."""
    types = {"l": pa.int64(), "i": pa.int32(), "b": pa.bool_(), "d": pa.float64(), "x": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], names=names.split())


def _ingest(raw: str):
    """(vec_id, label, embedding) -> (vec_id, u, g, x): class, group (label and length), raw parts; nulls where invalid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, gs, xs = ([None] * b.num_rows for _ in range(3))
            lists, groups = b.column(2), {}
            flat = lists.values.to_numpy(zero_copy_only=False).astype(raw) + np.dtype(raw).type(0)  # null parts are nan; -0 is 0
            starts, known = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            for i, label in enumerate(b.column(1).to_pylist()):
                x = flat[starts[i] : starts[i + 1]]
                if label is None or not known[i] or not len(x) or not np.isfinite(x).all() or not x.any():
                    continue
                if (g := groups.get((label, len(x)))) is None:
                    groups[label, len(x)] = g = xxhash.xxh64_intdigest(f"{label}/{len(x)}") >> 1
                xs[i], gs[i] = x.tobytes(), g
                us[i] = xxhash.xxh64_intdigest(xs[i], seed=g & 0xFFFFFFFF) >> 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(us, pa.int64()), pa.array(gs, pa.int64()), pa.array(xs, pa.binary())], names=["vec_id", "u", "g", "x"])

    return run


def unit(raws: list[bytes], raw: str) -> np.ndarray:
    """Rows as doubles of length one; scaled by the largest part first, so that none overflows."""
    x = np.frombuffer(b"".join(raws), raw).reshape(len(raws), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


def _encode(raw: str):
    """Adds the code to rows (u, g, x, n, rep)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            raws = b.column(2).to_pylist()
            sizes, codes = np.array([len(r) for r in raws]), np.empty((len(raws), CODE // 8), np.uint8)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                x = unit([raws[i] for i in at], raw)
                if n not in planes:
                    planes[n] = np.random.default_rng([7, x.shape[1]]).standard_normal((x.shape[1], CODE))
                codes[at] = np.packbits(x @ planes[n] > 0, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=["u", "g", "x", "n", "rep", "code"])

    return run


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, CODE // 64)


def _orders(seeds: list[int]):
    """(u, g, code) -> each vector's place in every order: some of its code's bits, shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks = [np.random.default_rng([8, s]).permutation(CODE)[:ORDER_BITS] for s in seeds]
        for b in batches:
            bits = np.unpackbits(_codes(b.column(2)).view(np.uint8), axis=1)
            for s, pick in zip(seeds, picks, strict=True):
                key = (bits[:, pick].astype(np.int64) << np.arange(ORDER_BITS)[::-1]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, s), pa.int32()), b.column(1), pa.array(key, pa.int64()), b.column(0), b.column(2)], names=["o", "g", "key", "u", "code"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (o, g, u, code) sorted by order, group and place: the nearest inside runs of BLOCK rows."""
    def nearest(ids: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(ids) < 2:
            return
        d = np.bitwise_count(codes[:, None, :] ^ codes[None, :, :]).sum(axis=2, dtype=np.int32)
        np.fill_diagonal(d, FAR)
        k = min(NEIGHBOURS, len(ids) - 1)
        ties = np.random.default_rng(len(ids)).random(d.shape, np.float32)  # else the first rows of a clump are in all its lists
        top = np.argpartition(d + ties, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(d, top, 1)
        i, j = np.nonzero(near <= FLOOR)
        yield _rows([ids[i], ids[top[i, j]], near[i, j]], "u v d", "lli")

    ids, codes, last = np.empty(0, np.int64), np.empty((0, CODE // 64), np.uint64), None
    for b in batches:
        o, g, u = (b.column(i).to_numpy() for i in range(3))
        c, start = _codes(b.column(3)), 0
        cuts = np.flatnonzero((o[1:] != o[:-1]) | (g[1:] != g[:-1])) + 1
        for stop in [*cuts.tolist(), len(u)]:
            if start == stop:
                continue
            if (o[start], g[start]) != last:
                yield from nearest(ids, codes)
                ids, codes, last = ids[:0], codes[:0], (o[start], g[start])
            ids, codes, start = np.concatenate([ids, u[start:stop]]), np.concatenate([codes, c[start:stop]]), stop
            while len(ids) >= BLOCK:
                yield from nearest(ids[:BLOCK], codes[:BLOCK])
                ids, codes = ids[BLOCK:], codes[BLOCK:]
    yield from nearest(ids, codes)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each vector's edges (u, v, d, new), ties by a hash; an edge known before is not new."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)]
        for b in batches:
            if not b.num_rows:
                continue
            u, v, d, new = (np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held))
            first = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
            u, v, d, new = u[first], v[first], d[first], new[first]
            starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
            place = np.arange(len(u)) - np.repeat(starts, np.diff(np.r_[starts, len(u)]))
            done, rest = (place < k) & (u != u[-1]), (place < k) & (u == u[-1])
            held = [c[rest] for c in (u, v, d, new)]  # its run may go on
            yield _rows([c[done] for c in (u, v, d, new)], "u v d new", "llib")
        yield _rows(held, "u v d new", "llib")

    return edges.select("u", "v", "d", "new").repartition("u").sortWithinPartitions("u", "d", F.xxhash64("u", "v"), "v", "new").mapInArrow(run, "u long, v long, d int, new boolean")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first column, cut so that no value of it lies in two batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        first = b.column(0).to_numpy()
        cut = int(np.searchsorted(first, first[-1]))
        if cut:
            yield pa.concat_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, new, kth, code) sorted by u, few a value: members of one neighbourhood
    against each other; pairs of which one is new and that are nearer than the other's kth."""
    for b in _runs(batches):
        u, v, new, kth = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        codes = _codes(b.column(4))
        at = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        n = np.diff(np.r_[at, len(u)])
        live = (n > 1) & np.logical_or.reduceat(new, at)
        at, n = at[live], n[live]
        for lo in range(0, len(at), 1000):
            a, m = at[lo : lo + 1000], n[lo : lo + 1000]
            place = np.arange(m.max())
            mask = place < m[:, None]
            idx = np.where(mask, a[:, None] + place, a[:, None])
            c, ids, fresh = codes[idx], v[idx], new[idx]
            d = np.bitwise_count(c[:, :, None, :] ^ c[:, None, :, :]).sum(axis=3, dtype=np.int32)
            ok = mask[:, :, None] & mask[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]) & (ids[:, :, None] != ids[:, None, :])
            ok &= (d < kth[idx][:, :, None]) & (d <= FLOOR)
            s, i, j = np.nonzero(ok)
            yield _rows([ids[s, i], ids[s, j], d[s, i, j]], "u v d", "lli")


def _first_orders(largest: int) -> int:
    """Orders to begin with: blocks miss more of the links the more of them a group has."""
    return max(ORDERS, int(np.log2(max(largest, 1) / BLOCK + 1) / 2))


def _first_graph(nodes: DataFrame, seeds: list[int]) -> DataFrame:
    placed = nodes.select("u", "g", "code").mapInArrow(_orders(seeds), "o int, g long, key long, u long, code binary")
    by = ["o", "g", "key", "u"]
    return placed.repartitionByRange(*by).sortWithinPartitions(*by).select("o", "g", "u", "code").mapInArrow(_blocks, "u long, v long, d int")


def _refine(scratch: Scratch, nodes: DataFrame, graph: DataFrame) -> tuple[DataFrame, int]:
    """One neighbours-of-neighbours join; the new graph and how many near edges are new in it."""
    back = _best(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "d", "new"), REVERSE)
    kth = graph.groupBy("u").agg(F.when(F.count("*") >= NEIGHBOURS, F.max("d")).otherwise(FAR).alias("kth")).withColumnRenamed("u", "v")
    small = nodes.select(F.col("u").alias("v"), "code").join(kth, "v", "left").select("v", F.coalesce("kth", F.lit(FAR)).alias("kth"), "code")
    rows = graph.select("u", "v", "new").unionByName(back.select("u", "v", "new")).join(small, "v").select("u", "v", "new", "kth", "code")
    found = rows.repartition("u").sortWithinPartitions("u").mapInArrow(_join, "u long, v long, d int")
    merged = scratch.write(_best(graph.select("u", "v", "d", F.lit(False).alias("new")).unionByName(found.withColumn("new", F.lit(True))), NEIGHBOURS))
    return merged, merged.where(F.col("new") & (F.col("d") <= NEAR)).count()


def _exact_edges(nodes: DataFrame, pairs: DataFrame, raw: str) -> DataFrame:
    """Of pairs (a, b) of classes of one group, those that link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep, sizes = np.zeros(b.num_rows, bool), np.array([len(x) for x in xs])
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                keep[at] = (unit([xs[i] for i in at], raw) * unit([ys[i] for i in at], raw)).sum(axis=1) >= THRESHOLD
            yield b.select([0, 1]).filter(pa.array(keep))

    one = lambda k: nodes.select(F.col("u").alias(k), F.col("x").alias("x" + k))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows sorted by their first column: the other columns of each run of equal ones."""
    for b in _runs(batches):
        key = b.column(0).to_numpy()
        rows = list(zip(*(b.column(i).to_pylist() for i in range(1, b.num_columns)), strict=True))
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(rows)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield rows[lo:hi]


def _links(ua: np.ndarray, na: np.ndarray, xa: np.ndarray, ub: np.ndarray, nb: np.ndarray, xb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact links between two sides: rows linked with each of a, with each of b, and a forest."""
    many_a, many_b, tree = np.zeros(len(ua), np.int64), np.zeros(len(ub), np.int64), np.empty((0, 2), np.int64)
    for k in range(0, len(ua), SQUARE):
        p = slice(k, k + SQUARE)
        hit = (xa[p] @ xb.T >= THRESHOLD) & (ua[p][:, None] != ub[None, :])
        many_a[p] = hit @ nb
        many_b += hit.T @ na[p]
        i, j = np.nonzero(hit)
        tree = forest(np.concatenate([tree, np.stack([ua[p][i], ub[j]], axis=1)]))
    return many_a, many_b, tree


def _squares(raw: str):
    """Rows (key, side, u, n, x) sorted by key: exact links between the two sides of a
    square (or within one): (u, v, links): per member the rows it links with, and a
    forest of the links themselves with links null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _sorted_runs(batches):
            side, u, n = (np.array(c) for c in list(zip(*rows, strict=True))[:3])
            x = unit([r[3] for r in rows], raw)
            a = side == 0
            b = ~a if side.any() else a
            many_a, many_b, tree = _links(u[a], n[a], x[a], u[b], n[b], x[b])
            ids, many = (np.r_[u[a], u[b]], np.r_[many_a, many_b]) if side.any() else (u, many_a)
            yield _rows([np.r_[ids, tree[:, 0]], [*[None] * len(ids), *tree[:, 1].tolist()], [*many.tolist(), *[None] * len(tree)]], "u v links", "lll")

    return run


MEMBER, CELL, EDGE, COUNT, OPEN = range(5)
_CELL = "kind int, a long, b long, m long, r double, z binary"
_CELL_NAMES, _CELL_KINDS = "kind a b m r z", "illldx"


def _cells(raw: str):
    """Rows (key, u, g, n, x) sorted by key: vectors gathered around centres, within the
    threshold's angle. MEMBER: vector, cell, rows of its cell it links with; CELL:
    cell, group, its rows, radius, centre; EDGE: a forest of the links inside cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _sorted_runs(batches):
            rows.sort()
            u, g, n = (np.array(c) for c in list(zip(*rows, strict=True))[:3])
            x, free = unit([r[3] for r in rows], raw), np.ones(len(rows), bool)
            while free.any():
                i = int(np.argmax(free))
                centre = x[free & (x @ x[i] >= THRESHOLD)].sum(axis=0) + x[i]  # the middle of what is near
                centre /= np.sqrt(centre @ centre)
                mine = free & (x @ centre >= THRESHOLD)
                mine[i] = True
                at = np.flatnonzero(mine)
                r = float(np.arccos(np.clip(x[at] @ centre, -1, 1)).max())
                free &= ~mine
                if 2 * r + SLACK <= ANGLE:
                    many, tree = n[at].sum() - n[at], np.stack([u[at[1:]], np.full(len(at) - 1, u[at[0]])], axis=1)
                else:
                    many, _, tree = _links(u[at], n[at], x[at], u[at], n[at], x[at])
                k = len(at)
                yield _rows([
                    [MEMBER] * k + [EDGE] * len(tree) + [CELL], [*u[at].tolist(), *tree[:, 0].tolist(), int(u[i])], [*[int(u[i])] * k, *tree[:, 1].tolist(), int(g[i])],
                    [*many.tolist(), *[None] * len(tree), int(n[at].sum())], [*[None] * (k + len(tree)), r], [*[None] * (k + len(tree)), centre.tobytes()],
                ], _CELL_NAMES, _CELL_KINDS)

    return run


def _near_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, side, cell, m, r, z) sorted by key: cells of one group, one side of a
    square against the other or one against itself. COUNT: cell, rows of the cells that
    link with it as a whole; EDGE: a forest of those; OPEN: two cells to be compared."""
    for rows in _sorted_runs(batches):
        side, ids, m, r = (np.array(c) for c in list(zip(*rows, strict=True))[:4])
        x = np.stack([np.frombuffer(t[4], np.float64) for t in rows])
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if side.any() else a
        many, tree = np.zeros(len(ids), np.int64), np.empty((0, 2), np.int64)
        for k in range(0, len(a), 256):
            p = a[k : k + 256]
            angle, wide = np.arccos(np.clip(x[p] @ x[b].T, -1, 1)), r[p][:, None] + r[b][None, :]
            once = np.ones(angle.shape, bool) if side.any() else ids[p][:, None] < ids[b][None, :]
            whole = once & (angle + wide + SLACK <= ANGLE)
            many[p] += whole @ m[b]
            np.add.at(many, b, whole.T @ m[p])
            i, j = np.nonzero(whole)
            tree = forest(np.concatenate([tree, np.stack([ids[p][i], ids[b][j]], axis=1)]))
            i, j = np.nonzero(once & ~whole & (angle - wide - SLACK <= ANGLE))
            yield _rows([np.full(len(i), OPEN), ids[p][i], ids[b][j], [None] * len(i)], "kind a b m", "illl")
        at = np.flatnonzero(many)
        yield _rows([[COUNT] * len(at) + [EDGE] * len(tree), np.r_[ids[at], tree[:, 0]], [*[None] * len(at), *tree[:, 1].tolist()], [*many[at].tolist(), *[None] * len(tree)]], "kind a b m", "illl")


def _squared(rows: DataFrame, by: str, size: int) -> DataFrame:
    """rows dealt into parts of about ``size`` per value of ``by``, a copy for each pair of parts: plus key, side."""
    parts = rows.groupBy(by).agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    mine = rows.join(parts, by).withColumn("mine", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int"))
    other = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return other.withColumn("key", F.xxhash64(by, F.least("mine", "other"), F.greatest("mine", "other"))).withColumn("side", F.when(F.col("mine") > F.col("other"), 1).otherwise(0))


def _by_key(rows: DataFrame, task: Callable, ddl: str, *columns: str) -> DataFrame:
    return rows.select("key", *columns).repartition("key").sortWithinPartitions("key").mapInArrow(task, ddl)


def _exact(scratch: Scratch, nodes: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """(u, links) and a forest of links (u, v), of all vectors of a group compared, in squares."""
    done = scratch.write(_by_key(_squared(nodes.select("u", "g", "n", "x"), "g", SQUARE), _squares(raw), "u long, v long, links long", "side", "u", "n", "x"))
    return done.where("v is null").groupBy("u").agg(F.sum("links").alias("links")), done.where("v is not null").select("u", "v")


def _enlarge(scratch: Scratch, nodes: DataFrame, full: DataFrame, comp: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """Links of the vectors (u) with saturated lists among each other: (u, links), and a
    forest (u, v). comp: (id, component) as far as it is known."""
    placed = full.join(comp.withColumnRenamed("id", "u"), "u", "left").withColumn("c", F.coalesce("component", "u"))
    many = F.count("*")
    parts = placed.groupBy("c").agg(F.greatest(F.least(F.ceil(many / PART), F.lit(MANY)), F.ceil(many / LARGE_PART)).cast("int").alias("parts"))
    keyed = placed.join(parts, "c").select("u", F.xxhash64("c", F.pmod(F.xxhash64("u"), F.col("parts"))).alias("key")).join(nodes.select("u", "g", "n", "x"), "u")
    out = scratch.write(_by_key(keyed, _cells(raw), _CELL, "u", "g", "n", "x"))
    member = out.where(F.col("kind") == MEMBER).select(F.col("a").alias("u"), F.col("b").alias("cell"), F.col("m").alias("links"))
    cells = out.where(F.col("kind") == CELL).select(F.col("a").alias("u"), F.col("b").alias("g"), "m", "r", "z")
    near = scratch.write(_by_key(_squared(cells, "g", CELLS), _near_cells, "kind int, a long, b long, m long", "side", "u", "m", "r", "z"))
    whole = near.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("cell")).agg(F.sum("m").alias("links"))
    counts = member.select("u", "links").unionByName(member.select("u", "cell").join(whole, "cell").select("u", "links"))
    edges = out.where(F.col("kind") == EDGE).select("a", "b").unionByName(near.where(F.col("kind") == EDGE).select("a", "b")).toDF("u", "v")
    pairs = near.where(F.col("kind") == OPEN).select("a", "b")
    if pairs.limit(1).count():
        sides = pairs.select(F.xxhash64("a", "b").alias("key"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("cell")), F.struct(F.lit(1).alias("side"), F.col("b").alias("cell")))).alias("s")).select("key", "s.*")
        found = scratch.write(_by_key(sides.join(member.select("u", "cell"), "cell").join(nodes.select("u", "n", "x"), "u"), _squares(raw), "u long, v long, links long", "side", "u", "n", "x"))
        counts = counts.unionByName(found.where("v is null").select("u", "links"))
        edges = edges.unionByName(found.where("v is not null").select("u", "v"))
    return counts.groupBy("u").agg(F.sum("links").alias("links")), edges


def _outcome(scratch: Scratch, nodes: DataFrame, graph: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """From the graph: (u, links) and (id, component). A link in no list has a saturated
    list at either end; all others are in the graph."""
    near = graph.where(F.col("d") <= NEAR)
    edges = scratch.write(_exact_edges(nodes, near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), raw))
    comp = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    full = scratch.write(near.groupBy("u").count().where(F.col("count") >= NEIGHBOURS).select("u"))
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = both.join(nodes.select(F.col("u").alias("v"), "n"), "v")
    if not full.limit(1).count():
        return scratch.write(both.groupBy("u").agg(F.sum("n").alias("links"))), comp
    tag = lambda k: full.select(F.col("u").alias(k), F.lit(True).alias("full_" + k))
    listed = both.join(tag("u"), "u", "left").join(tag("v"), "v", "left").where("full_u is null or full_v is null").select("u", F.col("n").alias("links"))
    counts, found = _enlarge(scratch, nodes, full, comp, raw)
    counts = scratch.write(listed.unionByName(counts).groupBy("u").agg(F.sum("links").alias("links")))
    ends = [comp.select(F.col("id").alias(k), F.col("component").alias("c" + k)) for k in ("u", "v")]
    new = found.join(ends[0], "u", "left").join(ends[1], "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).where("u <> v")
    new = scratch.write(new.distinct())
    if new.limit(1).count():
        comp = components(comp.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(new), scratch)
    return counts, comp


def _truth(nodes: DataFrame, size: int, raw: str) -> dict[int, int]:
    """Links of ``size`` classes, first by a hash, counted against all vectors."""
    asked = nodes.orderBy(F.xxhash64(F.lit(1), "u"), "u").limit(size).select("u", "g", "x").collect()  # size rows
    groups: dict = {}
    for r in asked:
        groups.setdefault(r.g, []).append(r)
    probes = {g: (np.array([r.u for r in rs]), unit([bytes(r.x) for r in rs], raw)) for g, rs in groups.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {g: np.zeros(len(ids), np.int64) for g, (ids, _) in probes.items()}
        for b in batches:
            us, g, n = (b.column(i).to_numpy() for i in range(3))
            for key in set(g.tolist()) & probes.keys():
                at = np.flatnonzero(g == key)
                ids, q = probes[key]
                x = unit(b.column(3).take(pa.array(at)).to_pylist(), raw)
                for k in range(0, len(ids), 1024):
                    hit = (q[k : k + 1024] @ x.T >= THRESHOLD) & (ids[k : k + 1024, None] != us[at][None, :])
                    found[key][k : k + 1024] += hit @ n[at]
        us, ks = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in ([ids for ids, _ in probes.values()], list(found.values())))
        yield _rows([us[ks > 0], ks[ks > 0]], "u k", "ll")

    return {r.u: r.k for r in nodes.select("u", "g", "n", "x").mapInArrow(run, "u long, k long").groupBy("u").agg(F.sum("k").alias("k")).collect()}  # at most size rows


def _recall(truth: dict[int, int], have: dict[int, int]) -> float:
    """Mean share of an audited vector's links that was found, of those with at most
    NEIGHBOURS links or of those with more, whichever is less; 1 where none has links."""
    share = {u: min(have.get(u, 0), k) / k for u, k in truth.items()}
    bands = [[share[u] for u, k in truth.items() if (k <= NEIGHBOURS) == few] for few in (True, False)]
    return min((float(np.mean(b)) for b in bands if b), default=1.0)


def _audit(counts: DataFrame, truth: dict[int, int]) -> float:
    asked = counts.sparkSession.createDataFrame([(u,) for u in truth], "u long")
    return _recall(truth, {r.u: r.links for r in counts.join(F.broadcast(asked), "u").collect()})  # at most AUDIT_MOST rows


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall) for every row of vectors
    (vec_id, embedding, label).

    Linked are vectors of one label and length whose cosine in doubles is THRESHOLD or
    more. Vectors that are null, empty, zero, or hold null or non-finite parts, and
    those with a null label, link with nothing. Equal vectors link with each other; with
    a third all do or none. component_id is the smallest vec_id reachable, kept whether
    it is the row's own. Repeated rows count as vectors of their own. Extra columns are
    ignored; an empty table gives no rows. An audited recall that stays short of RECALL
    leads to comparing all vectors of a group."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nn-descent")
    kind = vectors.schema["embedding"].dataType.simpleString()
    raw, element = ("<f4", "float") if kind == "array<float>" else ("<f8", "double")
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    rows = scratch.write(slim.mapInArrow(_ingest(raw), "vec_id long, u long, g long, x binary"))
    nodes = rows.where("u is not null").groupBy("u").agg(F.first("g").alias("g"), F.first("x").alias("x"), F.count("*").alias("n"), F.min("vec_id").alias("rep"))
    nodes = scratch.write(nodes.select("u", "g", "x", "n", "rep").mapInArrow(_encode(raw), "u long, g long, x binary, n long, rep long, code binary"))
    sizes = nodes.groupBy("g").count().agg(F.sum("count").alias("total"), F.max("count").alias("largest")).first()
    total, largest = sizes.total or 0, sizes.largest or 0
    truth = _truth(nodes, AUDIT, raw)
    if total > AUDIT and sum(k <= NEIGHBOURS for k in truth.values()) < AUDIT_FEW:
        truth = _truth(nodes, AUDIT_MOST, raw)
    seeds, graph = list(range(_first_orders(largest))), None
    while True:
        fresh = _first_graph(nodes, seeds).withColumn("new", F.lit(True))
        graph = scratch.write(_best(fresh if graph is None else fresh.unionByName(graph.withColumn("new", F.lit(False))), NEIGHBOURS))
        for _ in range(ROUNDS):
            old = graph
            graph, found = _refine(scratch, nodes, graph)
            scratch.drop(old)
            if not found:
                break
        counts, comp = _outcome(scratch, nodes, graph, raw)
        recall = _audit(counts, truth)
        if recall >= RECALL:
            break
        used = seeds[-1] + 1
        if used * BLOCK >= largest:
            counts, tree = _exact(scratch, nodes, raw)
            comp, recall = components(tree, scratch), _audit(counts, truth)
            break
        seeds = list(range(used, 2 * used))
    labelled = nodes.select("u", "n", "rep").join(comp.withColumnRenamed("id", "u"), "u", "left").join(counts, "u", "left").withColumn("component", F.coalesce("component", "u"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = scratch.write(labelled.join(least, "component").select("u", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    out = rows.select("vec_id", "u").join(final, "u", "left")
    cid = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), cid.eqNullSafe(F.col("vec_id")).alias("kept"), F.lit(float(recall)).alias("audited_recall"))
