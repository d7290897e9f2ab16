"""Toxicity by fuzzy lexicon matching in context.

The lexicon (whole terms, and stems that take any ending) is learned from labelled
rows. Words are matched by running a Levenshtein automaton of the word along a trie of
the lexicon, so misspelled terms are caught; words known from clean training texts are
never taken for misspellings. Each hit is weighed by a window of context: a term that
is quoted or reported counts less than one that is used. A logistic model of the
weighed evidence gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoform.llm.common import Scratch, release, widened

#: Bound of the labelled rows a model is fitted on, taken in the order of a hash of doc_id.
MAX_TRAIN = 8000
MIN_SHARE, MIN_PRECISION, CHANCE, STEMS, THRESHOLD = 0.015, 0.65, 0.5, (4, 5, 6, 7), 0.3
FUZZY, QUOTED, CONTEXT, CACHE_WORDS = 0.8, 0.3, 6, 200_000
#: Words that report speech, before a term that is told of and not used; a parameter of ``fit``.
REPORTING = frozenset({"said", "says", "called", "word", "term", "quote", "quoted", "wrote", "dijo", "dice", "palabra", "sagte", "sagt", "wort", "dit", "mot", "appelé"})
_OPEN = "\"“”„«»‘’'"
_SPACES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(c for c in range(128) if not chr(c).isalnum()), b"abcdefghijklmnopqrstuvwxyz" + b" " * sum(not chr(c).isalnum() for c in range(128)))
_WIDE = str.maketrans({c: " " for c in "“”„«»‘’…–—¿¡"})
#: What ``words`` cuts at, inside the brackets of a pattern.
_CUTS = r"\x00-/:-@\[-`{-\x7f“”„«»‘’…–—¿¡"


def words(text: str) -> list[bytes]:
    """Lower-cased words of a text, cut at everything but letters and digits."""
    if not text.isascii():
        text = text.lower()
        if any(c in text for c in "“”„«»‘’…–—¿¡"):
            text = text.translate(_WIDE)
    return text.encode().translate(_SPACES).split()


def edits(n: int) -> int:
    """Edits allowed for an entry of n letters."""
    return 0 if n < 5 else 1 if n < 10 else 2


@dataclass
class Lexicon:
    """Entries: (``term`` or ``stem*``, weight 0 to 1); ``clean``: words not to be taken for misspellings."""

    entries: tuple[tuple[str, float], ...]
    clean: frozenset[str] = frozenset()
    reporting: frozenset[str] = REPORTING
    cache: dict[bytes, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.trie: dict = {}
        #: Letters of a word that can matter: no whole term is so long, and no stem's edits reach so far.
        self.reach = max((len(e.rstrip("*")) for e, _ in self.entries), default=0) + 3
        heads, tails, inside = set(), set(), set()
        for e, weight in self.entries:
            stem, node = e.rstrip("*"), self.trie
            for c in stem:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((edits(len(stem)), e.endswith("*"), weight))
            k = edits(len(stem)) + 1  # of k parts one survives any k - 1 edits
            cut = [stem[len(stem) * i // k : len(stem) * (i + 1) // k] for i in range(k)]
            heads.add(cut[0])
            (inside if e.endswith("*") or k > 2 else tails).update(cut[1:])
        alt = lambda s: "|".join(map(re.escape, sorted(s)))
        arms = [f"(?:{alt(heads)})" if heads else "", f".*(?:{alt(tails)})$" if tails else "", f".*(?:{alt(inside)})" if inside else ""]
        self.maybe = re.compile("|".join(x for x in arms if x) or r"(?!)", re.S).match

    def match(self, word: str) -> tuple[float, int]:
        """(weight, edits) of the entry that word says most surely, within that entry's
        allowance of edits; (0, 0) if none."""
        best, n = (0.0, 0), len(word)
        stack = [(self.trie, list(range(n + 1)))]
        while stack:
            node, row = stack.pop()
            for c, child in node.items():
                if c == "":
                    for allowed, stem, weight in child:
                        d = min(row) if stem else row[n]
                        if d <= allowed and weight * FUZZY ** (d > 0) > best[0]:
                            best = (weight * FUZZY ** (d > 0), d)
                    continue
                new = [row[0] + 1]
                for j in range(n):
                    new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (word[j] != c)))
                if min(new) <= 2:
                    stack.append((child, new))
        return best

    def weight(self, w: bytes) -> float:
        """An entry's weight; FUZZY times that for a misspelling; else 0."""
        out = self.cache.get(w)
        if out is None:
            s = w.decode("utf-8", "ignore")
            head = s[: self.reach]
            out, d = self.match(head) if self.maybe(head) else (0.0, 0)
            out = 0.0 if d and s in self.clean else out
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[w] = out
        return out

    def evidence(self, text: str) -> tuple[float, int]:
        """(weighed hits, words) of a whole text."""
        ws = words(text)
        hits = {w: x for w in set(ws) if (x := self.weight(w))}
        if not hits:
            return 0.0, len(ws)
        total, low = 0.0, text.lower()
        alike = "|".join(re.escape(w.decode("utf-8", "ignore")) for w in sorted(hits))
        whole = re.finditer(rf"(?<![^{_CUTS}])(?:{alike})(?![^{_CUTS}])", low)
        for i, found in zip([i for i, w in enumerate(ws) if w in hits], whole, strict=False):
            around = set(x.decode("utf-8", "ignore") for x in ws[max(0, i - CONTEXT) : i])
            total += hits[ws[i]] * (QUOTED if _quoted(low, *found.span()) or around & self.reporting else 1.0)
        return total, len(ws)


def _quoted(text: str, start: int, end: int, reach: int = 60) -> bool:
    """Whether a quotation mark opens before and closes after, within reach, on one line."""
    left = text[max(0, start - reach) : start].rsplit("\n", 1)[-1]
    right = text[end : end + reach].split("\n", 1)[0]
    opens = [m for m in re.finditer(rf"(?:^|(?<=[\s(])|(?<=^))[{_OPEN}]", left)]
    return bool(opens) and bool(re.search(rf"[{_OPEN}](?:\s|[.,;:!?)]|$)", right)) and not re.search(rf"\w[{_OPEN}](?:\s|[.,;:!?)])", left[opens[-1].end() :])


@dataclass
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = features([self.lexicon.evidence(t or "") for t in texts])
        return 1 / (1 + np.exp(-(x @ np.array(self.weights))))


def features(found: list[tuple[float, int]]) -> np.ndarray:
    e, n = np.array(found, float).reshape(-1, 2).T
    return np.stack([np.ones_like(e), np.minimum(e, 1.0), np.log1p(e), np.minimum(e / np.maximum(n, 1) * 20, 1.0)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, steps: int = 40) -> np.ndarray:
    """Ridge-penalised logistic weights by Newton's method; the first column is the intercept."""
    w, pen = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, l2)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + pen * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2


def _keys(ws: set[str]) -> set[str]:
    return ws | {w[:k] + "*" for w in ws for k in STEMS if len(w) > k}


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bad, clean = Counter(), Counter()
    for b in batches:
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            (bad if y else clean).update(_keys({w.decode("utf-8", "ignore") for w in words(t)}))
    names = sorted(bad.keys() | clean.keys())
    for i in range(0, len(names), 50_000):
        part = names[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([bad[k] for k in part], pa.int64()), pa.array([clean[k] for k in part], pa.int64())], names=["key", "bad", "clean"])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three smallest-hash marks of each text's word triples; near copies share one, mostly."""
    for b in batches:
        marks = []
        for t in b.column(0).to_pylist():
            ws = words(t)
            h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3])) for i in range(max(1, len(ws) - 2))), np.uint64)
            marks.append([int((h * np.uint64(k)).min() >> np.uint64(1)) for k in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)])
        cols = [pa.array(c, pa.int64()) for c in zip(*marks, strict=True)] or [pa.array([], pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=["text", "toxic", "m0", "m1", "m2"])


def least_support(sizes: dict[int, int], n_bad: int, n: int) -> int:
    """Fewest toxic texts a key must be in: MIN_SHARE of them, and so many that among the
    keys in that many texts (sizes: texts -> keys) fewer than CHANCE are all toxic by luck."""
    for m in range(3, max(sizes, default=3) + 2):
        if m >= MIN_SHARE * n_bad and sum(k for t, k in sizes.items() if t >= m) * (n_bad / n) ** m < CHANCE:
            return m
    return max(sizes, default=3) + 2


def choose_entries(counts: list[tuple[str, int, int]], rate: float) -> list[tuple[str, float]]:
    """(key, weight) from keys frequent among toxic texts and rare among clean ones, (key,
    toxic texts, clean texts): a stem is kept only where it says more than the words and
    longer stems under it. Weight: the share of toxic texts beyond the base rate."""
    good, share = list(counts), {k: (b / (b + c) - rate) / (1 - rate) for k, b, c in counts}
    good.sort(key=lambda x: (2 * x[2] - x[1], x[0].endswith("*"), -len(x[0]), x[0]))
    out: list[tuple[str, int]] = []
    for k, b, _ in good:
        stem = k.rstrip("*")
        inside = any(o.endswith("*") and stem.startswith(o[:-1]) for o, _ in out)
        no_gain = k.endswith("*") and any(o.startswith(stem) and b <= 1.05 * ob for o, ob in out)
        if not inside and not no_gain:
            out = [(o, ob) for o, ob in out if not (k.endswith("*") and o.startswith(stem))]
            out.append((k, b))
    return sorted((o, round(share[o], 6)) for o, _ in out)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, reporting: frozenset[str] = REPORTING) -> Model | None:
    """Learn lexicon and weights from labelled, not held-out rows; None without toxic rows.

    At most ``max_train`` labelled rows are used, those first by a hash of doc_id, one of
    the rows that repeat an id; repeated texts count once. What reaches the driver is bounded by that number."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    ids = (
        labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64(F.lit(10), "doc_id"), "doc_id").limit(max_train)
    )
    train = scratch.write(
        docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")  # at most max_train rows
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).groupBy("text").agg(F.max("toxic").alias("toxic"))
        .mapInArrow(_mark, "text string, toxic int, m0 long, m1 long, m2 long")
    )
    for m in ("m0", "m1", "m2"):  # near copies would pass for independent texts
        thinned = scratch.write(train.groupBy(m).agg(F.min(F.struct("text", "toxic", *[x for x in ("m0", "m1", "m2") if x != m])).alias("s")).select(m, "s.*").select("text", "toxic", "m0", "m1", "m2"))
        scratch.drop(train)
        train = thinned
    counts = train.mapInArrow(_count_keys, "key string, bad long, clean long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"))
    counts = scratch.write(counts)
    n_bad = train.where("toxic = 1").count()
    if not n_bad:
        return None
    sizes = {r.t: r["count"] for r in counts.groupBy((F.col("bad") + F.col("clean")).alias("t")).count().collect()}  # at most max_train rows
    n = train.count()
    least = least_support(sizes, n_bad, n)
    likely = counts.where((F.col("bad") >= least) & (F.col("bad") >= MIN_PRECISION * (F.col("bad") + F.col("clean")))).collect()  # keys of the bounded sample
    entries = choose_entries([(r.key, r.bad, r.clean) for r in likely], n_bad / n)
    probe = Lexicon(tuple(entries))
    near = counts.where("clean > 0 and key not like '%*'").select("key").mapInArrow(lambda it: _near(it, probe), "key string").collect()  # misspelling-like words of the bounded sample
    lexicon = Lexicon(tuple(entries), frozenset(r.key for r in near), reporting)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, n = zip(*[lexicon.evidence(t) for t in b.column(0).to_pylist()], strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.float64()), pa.array(n, pa.int64()), b.column(1)], names=["e", "n", "y"])

    seen = train.mapInArrow(measure, "e double, n long, y int").collect()  # at most max_train rows of three numbers
    scratch.drop(train, counts)
    x, y = features([(r.e, r.n) for r in seen]), np.array([r.y for r in seen], float)
    return Model(Lexicon(lexicon.entries, lexicon.clean, reporting), tuple(map(float, logistic(x, y))))


def _near(batches: Iterator[pa.RecordBatch], probe: Lexicon) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [k for k in b.column(0).to_pylist() if probe.maybe(k[: probe.reach]) and probe.match(k[: probe.reach])[1] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["key"])


def score_documents(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs plus a score (0 to 1) and a prediction (1 from the threshold on), under
    ``names``; columns of those names are replaced. Null and empty texts score as texts without hits; with
    no model every score is 0. One narrow pass over whole texts."""
    docs = docs.drop(*names)
    schema = widened(docs, f"`{names[0]}` double, `{names[1]}` int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column("text").to_pylist()) if model else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*b.schema.names, *names])
        if model:
            model.lexicon.cache.clear()
        release()

    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document, fitted on its labels."""
    slim = docs.select("doc_id", "text")
    out = score_documents(slim, fit(slim, labels))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
