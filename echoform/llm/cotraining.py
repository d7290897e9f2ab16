"""Quality classifier by co-training.

Two views of a page: its text (character-class pairs, repetition, compressibility) and
its metadata (source, language, size, url and html markup). A logistic classifier per
view learns from labelled rows; in each round both look at every document and label, for
the other, some of those they are sure of. Both are then calibrated on rows set aside,
combined by a logistic model of the calibrated views, and score every document.

Features of texts are worked out once and kept as a scratch table. What a view is sure of
is looked for in the whole table; of that, the first by a hash of the features are
taught, a bounded number a round, texts of equal features once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoform.llm.common import Scratch, release
from echoform.llm.toxicity import logistic

#: Bounds of the labelled rows used for fitting (first by a hash of doc_id), and of the rows one view teaches the other in a round.
MAX_LABELLED, MAX_TAUGHT = 6000, 600
ROUNDS, SURE, KEEP = 4, 0.97, 0.5
#: The share of hashes first looked at holds so many times the rows wanted; it grows by as much while too few of them are sure ones.
SLACK = 16
CLASSES, META_DIM = 20, 512
TEXT_DIM = CLASSES * CLASSES + 10
_CLASS = np.full(256, 1, np.uint16)  # other ASCII
_CLASS[128:] = 0
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b"\t\x0b\x0c", b".", b",", b"!", b"?", b"|", b"*", b"#$%&", b"<>", b"{}[]()", b"=+", b"-_/", b"\"'`")):
    _CLASS[list(_set)] = _i + 2


def text_features(text: str | None) -> np.ndarray:
    """TEXT_DIM numbers of a whole text; the empty text gives zeros but for its flag."""
    out = np.zeros(TEXT_DIM, np.float32)
    data = (text or "").encode()
    if not data:
        out[-1] = 1.0
        return out
    c = _CLASS[np.frombuffer(data, np.uint8)]
    if len(c) > 1:
        pairs = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        out[: CLASSES * CLASSES] = np.sqrt(pairs / (len(c) - 1))
    words = data.split()
    n, kinds = max(len(words), 1), len(set(words))
    lines = data.split(b"\n")
    out[CLASSES * CLASSES :] = (
        kinds / n, len(set(lines)) / len(lines), len(zlib.compress(data, 1)) / len(data), np.log1p(len(data)) / 12, np.log1p(n) / 10, min(len(data) / n / 20, 2),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, min(len(lines) / n, 1), n < 5, 0,
    )
    return out


def meta_features(slots: list[list[int]]) -> np.ndarray:
    """One-hot rows of the slots of ``field=value`` tokens, with an intercept at 0."""
    out = np.zeros((len(slots), META_DIM))
    out[:, 0] = 1
    for i, s in enumerate(slots):
        out[i, s] = 1
    return out


def meta_slots(tokens: Column) -> Column:
    """Distinct slots 1 to META_DIM - 1 of tokens."""
    return F.array_distinct(F.transform(tokens, lambda t: (F.pmod(F.xxhash64(t), F.lit(META_DIM - 1)) + 1).cast("int")))


def page_meta(pages: DataFrame) -> DataFrame:
    """(doc_id, _page) : metadata tokens of each page; repeated pages: one of them, the least."""
    def band(c, k):
        return F.floor(F.log2(c + 1) * k).cast("string")
    url, html = F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit(""))
    token = lambda name, c: F.concat(F.lit(name + "="), c)
    tokens = F.array(
        token("scheme", F.substring_index(url, "://", 1)), token("suffix", F.regexp_extract(url, r"://[^/?#]*?\.?([^./?#]+)(?:[/?#]|$)", 1)),
        token("sub", F.regexp_extract(url, r"://([^./?#]+)", 1)), token("dir", F.regexp_extract(url, r"://[^/]*/([^/?#]*)", 1)),
        token("ext", F.regexp_extract(url, r"(\.[a-z]+)(?:[?#]|$)", 1)), token("query", url.contains("?").cast("string")), token("part", url.contains("#").cast("string")),
        token("html", band(F.length(html), 1)), token("links", band(F.size(F.split(html, "<a ")), 1)), token("scripts", F.least(F.size(F.split(html, "<script")), F.lit(9)).cast("string")),
        token("paragraphs", band(F.size(F.split(html, "<p")), 1)),
    )
    return pages.where("page_id is not null").select(F.col("page_id").alias("doc_id"), tokens.alias("t")).groupBy("doc_id").agg(F.min("t").alias("_page"))


def own_meta() -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.array(
        F.concat(F.lit("source="), F.coalesce(F.col("source").cast("string"), F.lit("?"))), F.concat(F.lit("lang="), F.coalesce(F.col("lang").cast("string"), F.lit("?"))),
        F.concat(F.lit("size="), F.floor(F.log2(F.greatest(F.coalesce(F.col("n_chars"), F.length(text)), F.lit(0)).cast("double") + 1) * 2).cast("string")),
    )


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_cal: tuple[float, float]
    meta_cal: tuple[float, float]
    mix: tuple[float, float, float]


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1), x.dtype), x]).astype(float)


#: Asks both views, of the weights given, for rows they are sure of, at most want[label] of each label;
#: returns for either what it teaches: features in the other view, and labels.
Teacher = Callable[[list[np.ndarray], float, tuple[int, int]], list[tuple[np.ndarray, np.ndarray]]]


def key_of(features: bytes) -> int:
    return xxhash.xxh64_intdigest(features) >> 1


def in_memory(x: np.ndarray, m: np.ndarray, keys: list[int] | None = None) -> Teacher:
    """Rows of both views in memory: the plain form of ``whole_table``."""
    keys = keys or [key_of(r.tobytes()) for r in x]
    used: set[int] = set()

    def ask(w: list[np.ndarray], sure: float, want: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
        out, taught = [], set()
        for own, other, weights in ((x, m, w[0]), (m, x, w[1])):
            p, chosen = _p(own @ weights), {}
            for label in (1, 0):
                first: dict[int, int] = {}
                for i in np.flatnonzero(p >= sure if label else p <= 1 - sure):
                    if keys[i] not in used:
                        first.setdefault(keys[i], int(i))
                for k in sorted(first)[: want[label]]:
                    chosen.setdefault(k, (first[k], label))
            out.append((other[[i for i, _ in chosen.values()]], np.array([v for _, v in chosen.values()], float)))
            taught |= set(chosen)
        used.update(taught)
        return out

    return ask


def cotrain(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray] | Teacher, rounds: int = ROUNDS, sure: float = SURE, most: int = MAX_TAUGHT) -> Model:
    """Fit both views on labelled rows, let them teach each other on the pool, calibrate and combine."""
    ask = pool if callable(pool) else in_memory(*pool)
    hold = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[~hold])) < 2 or len(np.unique(y[hold])) < 2:
        hold = np.zeros(len(y), bool)
    sets = [[v[~hold], y[~hold].astype(float)] for v in views]
    fit = lambda s: logistic(s[0], s[1], 1.0, 25)
    w = [fit(s) for s in sets]
    rate = float(y.mean())
    want = (int(most * (1 - rate)) + 1, int(most * rate) + 1)
    for _ in range(rounds):
        lessons = ask(w, sure, want)
        if not any(len(labels) for _, labels in lessons):
            break
        for s, (rows, labels) in zip(reversed(sets), lessons, strict=True):
            s[0], s[1] = np.vstack([s[0], rows]), np.r_[s[1], labels]
        w = [fit(s) for s in sets]
    at = hold if hold.any() else ~hold
    cal = []
    for v, x in zip(views, w, strict=True):
        c = logistic(_with_one((v[at] @ x)[:, None]), y[at].astype(float), 1e-3, 40)
        cal.append((float(c[0]), float(max(c[1], 0.0))))
    z = np.stack([c[0] + c[1] * (v[at] @ x) for c, v, x in zip(cal, views, w, strict=True)], axis=1)
    mix = logistic(_with_one(np.clip(z, -12, 12)), y[at].astype(float), 1e-2, 40)
    return Model(w[0], w[1], cal[0], cal[1], (float(mix[0]), float(max(mix[1], 0.0)), float(max(mix[2], 0.0))))


def read_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, h, x, _own): a key of the text's features, the features in half precision, and metadata tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [text_features(t).astype(np.float16).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(key_of, x), pa.int64()), pa.array(x, pa.binary()), b.column(2)], names=["doc_id", "h", "x", "_own"])
        release()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), own_meta().alias("_own"))
    return slim.mapInArrow(run, "doc_id long, h long, x binary, _own array<string>")


def _rows(x: list[bytes]) -> np.ndarray:
    return _with_one(np.frombuffer(b"".join(x), np.float16).reshape(len(x), TEXT_DIM))


def with_slots(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """rows (doc_id, .., _own) with slots m of their own tokens and of their pages'; meta: (doc_id, _page)."""
    return rows.join(meta, "doc_id", "left").withColumn("m", meta_slots(F.concat("_own", F.coalesce("_page", F.array().cast("array<string>"))))).drop("_own", "_page")


def meta_logit(weights: np.ndarray) -> Column:
    """Logit of the metadata view of slots m."""
    table = F.expr(f"array({', '.join(f'{float(v)!r}D' for v in weights)})")
    return F.aggregate("m", F.lit(float(weights[0])), lambda a, i: a + F.element_at(table, i + 1))


def whole_table(texts: DataFrame, metas: DataFrame, used: set[int]) -> Teacher:
    """Every row of texts (doc_id, h, x) and metas (doc_id, h, m) but those of keys used
    or null ids. A key is a hash, so its smallest values are an even sample: only those
    under a cut leave the scan. The cut grows until rows enough are there, or all were
    looked at; so some multiple of the rows wanted is sent on, whatever the table's size."""
    spark, n, used = texts.sparkSession, max(texts.count(), 1), set(used)
    cuts: dict[tuple[int, int], float] = {}

    def confident(w: list[np.ndarray], sure: float) -> DataFrame:
        edge, limit = float(np.log(sure / (1 - sure))), {k: 2 * int(c * 2**62) - 1 for k, c in cuts.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                z, h = _rows(b.column(2).to_pylist()) @ w[0], b.column(1).to_numpy()
                for label in (0, 1):
                    at = pa.array(((z >= edge) if label else (z <= -edge)) & (h <= limit[0, label]))
                    ids, keys = b.column(0).filter(at), b.column(1).filter(at)
                    yield pa.RecordBatch.from_arrays([pa.array([0] * len(ids), pa.int32()), pa.array([label] * len(ids), pa.int32()), keys, ids], names=["view", "label", "h", "doc_id"])
            release()

        z = meta_logit(w[1])
        by_text = texts.where("doc_id is not null").select("doc_id", "h", "x").mapInArrow(run, "view int, label int, h long, doc_id long")
        by_meta = (
            metas.where((F.col("h") <= max(limit[1, 0], limit[1, 1])) & F.col("doc_id").isNotNull()).select(F.lit(1).alias("view"), F.when(z >= edge, 1).when(z <= -edge, 0).alias("label"), "h", "doc_id")
            .where(F.col("h") <= F.when(F.col("label") == 1, limit[1, 1]).when(F.col("label") == 0, limit[1, 0]))
        )
        known = spark.createDataFrame(pa.table({"h": pa.array(sorted(used), pa.int64())}))  # bounded: labelled and taught rows
        return by_text.unionByName(by_meta).join(F.broadcast(known), "h", "left_anti").groupBy("view", "label", "h").agg(F.min("doc_id").alias("doc_id"))

    def ask(w: list[np.ndarray], sure: float, want: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
        for view in (0, 1):
            for label in (0, 1):
                cuts.setdefault((view, label), min(1.0, SLACK * want[label] / n))
        while True:
            found = confident(w, sure).collect()  # keys are even hashes: about SLACK times the rows wanted at most
            rows = [r for v, k in cuts for r in sorted((r for r in found if (r.view, r.label) == (v, k)), key=lambda r: r.h)[: want[k]]]
            short = [(v, k) for v, k in cuts if cuts[v, k] < 1 and sum(r.view == v and r.label == k for r in rows) < want[k]]
            if not short:
                break
            cuts.update({c: min(1.0, SLACK * cuts[c]) for c in short})
        chosen: dict[tuple[int, int], tuple[int, int]] = {}
        for r in sorted(rows, key=lambda r: (r.view, -r.label, r.h)):
            chosen.setdefault((r.view, r.h), (r.label, r.doc_id))
        if not chosen:
            return [(np.zeros((0, len(w[1]))), np.zeros(0)), (np.zeros((0, len(w[0]))), np.zeros(0))]
        used.update(h for _, h in chosen)
        ids = spark.createDataFrame([(v, h, d) for (v, h), (_, d) in chosen.items()], "view int, k long, id long")
        # one long key: a broadcast relation of two would hold a whole memory page on every executor
        take = lambda t, view: t.join(F.broadcast(ids.where(F.col("view") == view)), (F.col("doc_id") == F.col("id")) & (F.col("h") - F.col("k") == 0))
        got = take(metas, 0).groupBy("view", "h").agg(F.min("m").alias("m")).withColumn("x", F.lit(None).cast("binary"))
        got = got.unionByName(take(texts, 1).groupBy("view", "h").agg(F.first("x").alias("x")).withColumn("m", F.lit(None).cast("array<int>"))).collect()
        mine = [sorted((r for r in got if r.view == v), key=lambda r: (-chosen[v, r.h][0], r.h)) for v in (0, 1)]
        labels = [np.array([chosen[r.view, r.h][0] for r in m], float) for m in mine]
        return [(meta_features([r.m for r in mine[0]]), labels[0]), (_rows([bytes(r.x) for r in mine[1]]), labels[1])]

    return ask


def fit(texts: DataFrame, metas: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """Fit on labelled rows of a bounded number of ids, one row of those that repeat an id,
    and on what the views teach each other of all other rows; None where labels lack one
    of the classes. Tables as in ``whole_table``."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    first = {r.doc_id: r.y for r in known.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(max_labelled).collect()}
    if len(set(first.values())) < 2:
        return None
    ids = F.broadcast(texts.sparkSession.createDataFrame([(i,) for i in first], "doc_id long"))
    x = {r.doc_id: r.s for r in texts.join(ids, "doc_id").groupBy("doc_id").agg(F.min(F.struct("h", "x")).alias("s")).collect()}
    m = {r.doc_id: r.s for r in metas.join(ids, "doc_id").groupBy("doc_id").agg(F.min(F.struct("h", "m")).alias("s")).collect()}
    rows = sorted(x, key=lambda i: (xxhash.xxh64_intdigest(str(i)), i))
    y = np.array([first[i] for i in rows])
    if len(set(y.tolist())) < 2:  # labels of rows that are not there
        return None
    views = _rows([bytes(x[i].x) for i in rows]), meta_features([m[i].m for i in rows])
    return cotrain(views, y, whole_table(texts, metas, {x[i].h for i in rows}))


def score_documents(docs: DataFrame, pages: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """(doc_id, text_score, page_score, score, kept) for every document row.

    Scores are chances of good quality; ``kept`` is score >= keep. Null and empty texts
    are scored by their own flag, documents without a page by their own metadata.
    A negative n_chars counts as 0, a null one as the text's own. Repeated rows keep a
    row each; rows without an id are scored, not taught; extra columns are ignored; an
    empty table gives no rows. Without labels of both classes all score 1. Texts are
    read in one narrow pass; only ids, keys, logits and metadata tokens are joined."""
    scratch = Scratch(docs.sparkSession, "quality")
    texts = scratch.write(read_texts(docs))
    meta = scratch.write(page_meta(pages))
    metas = scratch.write(with_slots(texts.select("doc_id", "h", "_own"), meta))
    model = fit(texts.drop("_own"), metas, labels)
    scratch.drop(metas)
    names = ["doc_id", "text_score", "page_score", "score"]
    if model is None:
        return texts.select("doc_id", *(F.lit(1.0).alias(n) for n in names[1:])).withColumn("kept", F.col("score") >= keep)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_rows(b.column(1).to_pylist()) @ model.text), b.column(2)], names=["doc_id", "z", "_own"])
        release()

    chance = lambda z: 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    level = lambda z: F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    rows = with_slots(texts.select("doc_id", "x", "_own").mapInArrow(logits, "doc_id long, z double, _own array<string>"), meta)
    a, c = model.text_cal[0] + model.text_cal[1] * F.col("z"), model.meta_cal[0] + model.meta_cal[1] * meta_logit(model.meta)
    rows = rows.select("doc_id", a.alias("a"), c.alias("c"))
    mixed = model.mix[0] + model.mix[1] * level(F.col("a")) + model.mix[2] * level(F.col("c"))
    return rows.select("doc_id", chance(F.col("a")).alias("text_score"), chance(F.col("c")).alias("page_score"), chance(mixed).alias("score")).withColumn("kept", F.col("score") >= keep)
