import base64
import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from echoform.llm import bpe, common, cotraining, fingerprints, nn_descent, packing, parity_join, queries, sharding, toxicity, url_reputation, warc

DATA = "/root/testdata/sf0.001"
BYTE, WORD = queries.BYTE_BPE, queries.WORD_BPE
#: Columns whose names clash with the operators' own.
EXTRA = ["score", "predicted", "cls", "part", "u", "x", "r", "kind", "fingerprint", "ids", "shard", "_z", "m0", "kept", "component_id"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def nasty(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven eight nine", "en", "a", 10), (2, "ONE two three four five six seven eight nine", "en", "a", None), (3, None, None, None, None),
        (4, "", "en", "b", 0), (5, " \n\t ", "en", "b", 3), (6, long, "en", "b", len(long)), (7, long + " tail", "de", "a", 1), (8, "é🙂 über İ x", "de", "a", 5),
        (9, "one two three four five six seven eight nine", "en", "a", 10), (9, "one two three four five six seven eight nine", "en", "a", 10), (None, "no id here at all", "en", None, 4), (10, "short", "fr", "c", 5),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in EXTRA:
        df = df.withColumn(c, F.lit("extra"))
    return df, rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(items, linked):
    parent = {k: k for k in items}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(items)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(items[a], items[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {k: top(k) for k in keys}


def test_every_operator_on_empty_tables(spark):
    docs, pages = empty(spark), spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (
        nn_descent.near_duplicates(vectors), fingerprints.edit_fingerprints(docs), cotraining.score_documents(docs, pages, labels(spark)), parity_join.jaccard_components(docs),
        warc.archive_round_trip(pages), url_reputation.filter_urls(pages, spark.createDataFrame([], "page_id long, bad int")), packing.pack_documents(docs, WORD),
        bpe.round_trip(docs, BYTE), sharding.shard_documents(docs), toxicity.judge(docs, labels(spark)),
    ):
        assert df.count() == 0


def test_document_operators_on_nasty_rows(spark):
    docs, rows = nasty(spark)
    pages = spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")
    some = labels(spark, [(1, 1, 0), (2, 0, 1), (None, None, None), (6, 1, 0), (6, 1, 0)])
    for df in (fingerprints.edit_fingerprints(docs), cotraining.score_documents(docs, pages, some), parity_join.jaccard_components(docs), bpe.round_trip(docs, BYTE), sharding.shard_documents(docs), toxicity.judge(docs, some)):
        assert df.count() == len(rows)
    assert bpe.decode_documents(bpe.encode_documents(docs, BYTE), BYTE).where("decoded <> coalesce(text, '')").count() == 0
    assert fingerprints.fingerprints(docs).columns == [c for c in docs.columns if c != "fingerprint"] + ["fingerprint"]
    got = {r.doc_id: r for r in parity_join.jaccard_components(docs).collect()}
    assert got[2].component_id == got[9].component_id == 1 and got[7].component_id == 6 and got[5].n_shingles == 0 == got[3].n_shingles
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, base, DATA).columns == base.columns


# -- 1 ---------------------------------------------------------------------------------
def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows, truth, i = [], defaultdict(dict), 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.standard_normal(16)
            for _ in range(rng.integers(1, 30)):
                v = centre + rng.standard_normal(16) * 0.04
                rows.append((i, [float(x) for x in np.float32(v)], label))
                if label is not None:
                    truth[label][i] = np.array(rows[-1][1])
                i += 1
    rows += [(i, rows[0][1], 0), (i + 1, rows[0][1], 1), (i + 2, [0.0] * 16, 0), (i + 3, None, 0), (i + 4, [float("nan")] * 16, 0), (i + 5, [None] + [1.0] * 15, 0), (i + 6, [1e30] * 16, 0), (i + 7, [1.0, 2.0], 0)]
    truth[0][i], truth[1][i + 1], truth[0][i + 6] = np.array(rows[0][1]), np.array(rows[0][1]), np.full(16, 1.0)
    got = {r.vec_id: r for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("u", F.lit(1))).collect()}
    assert len(got) == len(rows)
    for group in truth.values():
        unit = {k: v / np.linalg.norm(v) for k, v in group.items()}
        comp = brute_components(unit, lambda a, b: a @ b >= 0.98)
        for k, v in unit.items():
            assert got[k].n_links == sum(v @ w >= 0.98 for j, w in unit.items() if j != k)
            assert got[k].component_id == comp[k] and got[k].kept == (comp[k] == k)
    assert all(got[i + j].n_links == 0 for j in (2, 3, 4, 5, 7))


def test_dense_clumps_link_across(spark):
    """Lists full of a clump's own members hide the links to the next clump, 0.985 away."""
    rng = np.random.default_rng(3)
    axes = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    turn = np.arccos(0.985)
    centres = [axes[0], np.cos(turn) * axes[0] + np.sin(turn) * axes[1], axes[2]]
    rows = [(i, [float(v) for v in c + rng.standard_normal(64) * 0.002], 0) for i, c in enumerate(np.repeat(centres, 20, axis=0))]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    got = {r.vec_id: r for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    comp = brute_components(unit, lambda a, b: a @ b >= 0.98)
    assert sorted(set(comp.values())) == [0, 40]
    for k, v in unit.items():
        assert (got[k].n_links, got[k].component_id) == (sum(v @ w >= 0.98 for j, w in unit.items() if j != k), comp[k])


def test_scattered_pairs_are_found_beside_a_hot_group(spark, monkeypatch):
    """A third of all vectors link with each other; the pairs must not be lost behind them."""
    monkeypatch.setattr(nn_descent, "ORDERS", 1)
    rng = np.random.default_rng(9)
    single, hot = rng.standard_normal((6000, 64)), rng.standard_normal(64) + rng.standard_normal((3000, 64)) * 0.02
    twin = single[:800] + rng.standard_normal((800, 64)) * 0.17
    x = np.concatenate([single, twin, hot])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = [i for i in range(800) if unit[i] @ unit[6000 + i] >= 0.98]
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r for r in nn_descent.near_duplicates(rows).collect()}
    found = np.mean([got[i].component_id == got[6000 + i].component_id for i in linked])
    assert len(linked) > 400 and found > 0.95 and 0.97 <= got[0].audited_recall <= 1
    truth = {**{i: 1 for i in range(40)}, **{100 + i: 3000 for i in range(4000)}}
    assert nn_descent._recall(truth, {u: k for u, k in truth.items() if k > 1 or u < 10}) == 0.25


def test_neighbour_joins_find_what_blocks_miss(spark, monkeypatch):
    """Groups of seven among 3500 vectors a label, two orders of small blocks: a vector is
    beside some of its group in each, and the joins find the others."""
    for name, value in (("BLOCK", 16), ("_first_orders", lambda largest: 2), ("RECALL", 0.0)):
        monkeypatch.setattr(nn_descent, name, value)
    rng = np.random.default_rng(4)
    x = (np.repeat(rng.standard_normal((1000, 48)), 7, axis=0) + rng.standard_normal((7000, 48)) * 0.11).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), int(i >= 3500)) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.array([((unit[i // 7 * 7 : i // 7 * 7 + 7] @ unit[i]) >= 0.98).sum() - 1 for i in range(7000)])
    share = lambda: sum(r.n_links for r in nn_descent.near_duplicates(rows).collect()) / want.sum()
    joined = share()
    monkeypatch.setattr(nn_descent, "_refine", lambda scratch, nodes, graph: (scratch.write(graph), 0))
    assert share() < 0.96 and 0.98 < joined <= 1


def test_loose_clumps_are_counted_by_cells(spark):
    """Vectors of clumps wider than a cell: cells link as a whole, by members, or not at all."""
    rng = np.random.default_rng(14)
    x = np.concatenate([rng.standard_normal(32) + rng.standard_normal((120, 32)) * s for s in (0.05, 0.11, 0.15, 0.2)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.98
    got = {r.vec_id: r for r in nn_descent.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    comp = brute_components(dict(enumerate(range(480))), lambda a, b: link[a, b])
    assert [(got[i].n_links, got[i].component_id) for i in range(480)] == [(int(link[i].sum()) - 1, comp[i]) for i in range(480)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500, k) for k in range(501, 560)]
    scratch = common.Scratch(spark, "test")
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long"), scratch).collect()}
    adj = defaultdict(set)
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    comp = {}
    for k in sorted(adj):
        if k not in comp:
            stack = [k]
            while stack:
                x = stack.pop()
                if x not in comp:
                    comp[x] = k
                    stack += adj[x]
    assert got == {k: c for k, c in comp.items() if k != c}


# -- 2 ---------------------------------------------------------------------------------
def test_fingerprints_against_plain_loop(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    got = sorted(fingerprints.edit_fingerprints(docs).collect())
    texts = [r.text or "" for r in rows]
    for i, (r, t) in enumerate(zip(got, texts, strict=True)):
        follow, half = texts[(i + 1) % len(texts)], len(t) // 2
        want = t[: len(t) - half] + follow[:half]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (rows[i].doc_id, len(t), hashlib.sha256(want.encode()).hexdigest())
        assert r.fingerprint == fingerprints.fingerprint(t.encode()) and r.edited_fingerprint == fingerprints.fingerprint(want.encode())
    assert np.mean([r.near_edited for r in got]) > 0.45 > 0.1 > np.mean([r.near_next for r in got])
    def plain(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1][j + 1] = t[i][j] + 1 if x[i] == y[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]
    draw = random.Random(4)
    xs, ys = ([ "".join(draw.choice("ABcd") for _ in range(draw.randrange(65))) for _ in range(40)] for _ in range(2))
    assert fingerprints._lcs(xs, ys).tolist() == [plain(x, y) for x, y in zip(xs, ys, strict=True)]
    same = fingerprints.fingerprint(b"x" * 999)
    assert fingerprints.likeness([same, "1::"], [same, same]).tolist() == [1.0, 0.0]


def test_repetitive_texts_keep_signatures():
    draw, likes = random.Random(6), []
    for _ in range(100):
        line = "".join(draw.choice("abcdefgh ijkl") for _ in range(40)) + "\n"
        text = line * 200
        f, g = (fingerprints.fingerprint(t.encode()) for t in (text, text[:-40] + "another end of the text"))
        assert len(f.split(":")[1]) >= fingerprints.MAX_CHUNKS // 2
        likes.append(fingerprints.likeness([f], [g])[0])
    assert np.mean(likes) > 0.9


def test_letters_span_texts_rich_in_boundaries():
    """More than half of a text of repeated lines is replaced, well after 63 boundaries."""
    draw, likes = random.Random(8), []
    for _ in range(100):
        a, b = ("".join(draw.choice("abcdefgh ijkl") for _ in range(40)) + "\n" for _ in range(2))
        likes.append(fingerprints.likeness(*([fingerprints.fingerprint(t.encode())] for t in (a * 200, a * 80 + b * 120)))[0])
    assert max(likes) < 0.9


# -- 3 and 10 --------------------------------------------------------------------------
@pytest.mark.parametrize("sf", ["sf0.01"])
def test_classifiers_on_held_out_rows(spark, sf):
    docs, pages, known = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "pages", "labels"))
    got = cotraining.score_documents(docs, pages, known).join(known, "doc_id")
    assert got.where("kept and quality = 1").count() >= 0.99 * got.where("quality = 1").count()
    assert got.where("not kept and quality = 0").count() >= 0.8 * got.where("quality = 0").count()
    tox = toxicity.judge(docs, known).join(known, "doc_id").where("held_out")
    assert tox.where("predicted = toxic").count() >= 0.9 * tox.count()


def test_cotraining_lets_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    views = tuple(np.c_[np.ones(400), y * 4 - 2 + rng.standard_normal(400), rng.standard_normal(400)] for _ in range(2))
    m = cotraining.cotrain(tuple(v[:40] for v in views), y[:40], tuple(v[40:] for v in views), sure=0.9)
    z = [c[0] + c[1] * (v @ w) for c, v, w in zip((m.text_cal, m.meta_cal), views, (m.text, m.meta), strict=True)]
    assert (((m.mix[0] + m.mix[1] * z[0] + m.mix[2] * z[1]) > 0) == y).mean() > 0.95


def test_fuzzy_lexicon_and_context():
    lex = toxicity.Lexicon((("moron", 1.0), ("lowei*", 1.0), ("disgusting", 1.0)), frozenset({"oron"}))
    weigh = lambda w: lex.weight(w.encode())
    assert weigh("moron") == weigh("loweischaft") == 1 and weigh("disgustng") == weigh("m0ron") == toxicity.FUZZY and weigh("oron") == weigh("morning") == 0
    used, quoted, told = (lex.evidence(t)[0] for t in ("you moron go", 'they wrote "moron" there', "he called him a moron"))
    assert used == 1 and quoted == told == toxicity.QUOTED
    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]
    draw = random.Random(1)
    plain = toxicity.Lexicon((("moron", 1.0), ("trashy", 1.0)))
    for _ in range(3000):
        w = "".join(draw.choice("moratshy") for _ in range(draw.randrange(3, 8)))
        want = min((edit(w, t) for t in ("moron", "trashy") if edit(w, t) <= toxicity.edits(len(t))), default=None)
        assert (plain.match(w)[0] > 0) == (want is not None)
        assert want is None or plain.maybe(w)


# -- 4 ---------------------------------------------------------------------------------
def test_jaccard_components_against_brute_force(spark):
    draw = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    passage = draw.sample(words, 60)
    for _ in range(25):
        base = draw.sample(words, draw.randrange(4, 120))
        for _ in range(draw.randrange(1, 40)):
            t = list(base)
            for _ in range(draw.randrange(0, 4)):
                t[draw.randrange(len(t))] = draw.choice(words)
            texts.append(" ".join(t + (passage if draw.random() < 0.2 else [])))
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    link = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)
    comp = brute_components(sets, link)
    assert {i: r.component_id for i, r in got.items()} == comp and all(got[i].n_shingles == len(s) for i, s in sets.items())


def test_small_sets_at_the_threshold_all_link(spark):
    rows = []
    for i in range(600):
        words = [f"w{i}x{j}" for j in range(8)]
        rows += [(2 * i, " ".join(words[:7])), (2 * i + 1, " ".join(words))]  # 3 shared of 4
    got = {r.doc_id: r.component_id for r in parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(1200)}


def test_long_sets_at_the_threshold_all_link(spark):
    """Pairs at exactly 3/4 of 20,000 tokens: in the comparison, and through the whole join."""
    rng = np.random.default_rng(12)
    for _ in range(1000):
        whole = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) << np.uint64(1))
        whole = whole[: len(whole) // 4 * 4]
        part = np.sort(rng.permutation(whole)[: len(whole) * 3 // 4])
        assert parity_join.links(whole, part) and parity_join.links(part, whole) and not parity_join.links(whole, part[1:])
    rows = []
    for i in range(20):
        words = [f"w{i}x{j}" for j in range(20_000)]  # 19,996 shingles
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words[: 14_997 + 4])), (3 * i + 2, " ".join(["other", *words[: 14_996 + 4]]))]
    got = {r.doc_id: r.component_id for r in parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[3 * i] == got[3 * i + 1] == 3 * i for i in range(20))


@pytest.mark.parametrize("rows_a_side", [3, 8192])
def test_weak_sets_in_blocks_against_brute_force(spark, monkeypatch, rows_a_side):
    """Texts that are mostly passages many share: their pieces are hot, stars link them to
    one centre only, and the rest is found in square blocks of any size."""
    monkeypatch.setattr(parity_join, "SIDE_ROWS", rows_a_side)
    draw, rows = random.Random(21), []
    passages = [[f"p{k}x{j}" for j in range(90)] for k in range(3)]
    for i in range(240):
        t = list(draw.choice(passages))
        own = [f"d{i if draw.random() < 0.5 else i // 8}x{j}" for j in range(draw.choice((6, 14, 24, 40)))]
        for _ in range(draw.randrange(3)):
            t[draw.randrange(len(t))] = f"e{draw.randrange(40)}"
        rows.append((i, " ".join(t + own)))
    got = {r.doc_id: r.component_id for r in parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    assert got == brute_components(sets, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))


def test_short_sketches_bound_the_difference():
    rng = np.random.default_rng(6)
    for n in (3, 40, 65, 300, 5000):
        whole = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        part = np.sort(rng.permutation(whole)[: -(-3 * len(whole) // 4)])
        other = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        x, y, z = (parity_join.short(parity_join.sketch(s)) for s in (whole, part, other))
        assert len(x) == max(32, len(parity_join.sketch(whole)) // 4)
        assert parity_join.may_link(x, y, len(whole), len(part)) and not (n >= 300 and parity_join.may_link(x, z, len(whole), len(other)))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, 900).astype(np.uint64)
        a, b = np.unique(pool[: rng.integers(3, 600)]), np.unique(pool[rng.integers(0, 200) : rng.integers(300, 900)])
        union, common_ = len(np.union1d(a, b)), len(np.intersect1d(a, b))
        if 100 * common_ >= 75 * union:
            assert parity_join.may_link(parity_join.sketch(a), parity_join.sketch(b), len(a), len(b))


# -- 5 ---------------------------------------------------------------------------------
def test_warc_round_trip(spark):
    rows = [(5, "http://a/x y\r\n", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://b", None), (4, "http://c", ""), (1, "http://d", "é" * 5000), (None, "http://e", "<p>same</p>"), (6, "http://f", "<p>6</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {5: 2, None: 2, 4: 3}
    root = common.Scratch(spark, "t").path("w")
    index = warc.write_archives(pages, root, min_bytes=100)
    full = warc.read_records(index.where("page_id in (1, 6)"), root).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in full} == {1: "é" * 5000, 6: "<p>6</p>"} and index.where("record_type = 'revisit'").count() == 0
    assert warc.coalesce([("a", 0, 5), ("a", 5, 5), ("a", 10**9, 1), ("b", 0, 2)]) == [("a", 0, 10, 0, 2), ("a", 10**9, 1, 2, 3), ("b", 0, 2, 3, 4)]


# -- 6 ---------------------------------------------------------------------------------
def test_urls(spark):
    rows = [
        (1, "http://M.Example.COM/en/71?x#y"), (2, "https://a.example.com/en/1"), (3, "ftp://example.net/de/8"), (4, "http://net/de"), (5, None), (6, "no scheme"), (7, "http://h?q"), (8, "http://badcom/en/"), (9, "http://q.org/es/#f"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("found", F.lit(1))
    got = {r.page_id: r for r in url_reputation.filter_urls(pages, spark.createDataFrame([(None, 1), (1, None)], "page_id long, bad int")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("m.example.com", "/en/71", "example.com/en/7", "allow")
    assert [(got[i].rule, got[i].verdict) for i in (2, 3, 4, 5, 8, 9)] == [("com/en/", "block"), ("example.net/de/8", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/es/", "block")]
    assert (got[5].host, got[6].path, got[7].host) == ("", "", "h")
    many = spark.createDataFrame([(i, f"http://{'bad' if i < 40 else 'ok'}.site.org/p") for i in range(400)], "page_id long, url string")
    out = spark.createDataFrame([(i, int(i < 40)) for i in range(400)], "page_id long, bad int")
    verdict = {r.host: r.verdict for r in url_reputation.filter_urls(many, out).collect()}
    assert verdict == {"bad.site.org": "block", "ok.site.org": "allow"}


# -- 7 and 8 ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def odd_texts():
    draw, letters = random.Random(3), " \n\t\r\x1c\x85\xa0aAbZéÉİß'sdtll.,!?1２<|endoftext|>中🙂\x00|*&"
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(0, 16))) for _ in range(3000)] + ["a<|endoftext|>b", "İ!", "x" * 5000, "ab" * 300 + "é" * 400, ""]


def test_bpe_equals_the_library(odd_texts):
    lib, own = Tokenizer.from_file(BYTE), bpe.Codec(BYTE)
    for t in odd_texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_packing_tokens_equal_the_library(odd_texts):
    lib, own, dice = Tokenizer.from_file(WORD), packing.Tokenizer(WORD, 500), random.Random(1)
    signs = [*"abzAZ'.,!?-_`~<>|09 \t\n\x0b\x1c\x85\xa0\u0301\u0130\u0131\u00df\u1e9e\u017f\u212a\ud55c\u1112\u1161\u4e2d\u03a3\u03c2\u3000\u02b0", "don't", "<|endoftext|>"]
    mixed = ["".join(dice.choices(signs, k=dice.randint(0, 14))) for _ in range(5000)]
    for texts in (odd_texts, mixed, [], odd_texts):  # words are forgotten in between
        ids, lengths = own(pa.array(texts, pa.string()))
        for t, part in zip(texts, np.split(ids, np.cumsum(lengths)), strict=False):
            assert part.tolist() == [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert len(lengths) == len(texts) and lengths.sum() == len(ids)


def test_packing_covers_every_id_within_limits(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lib = Tokenizer.from_file(WORD)
    for limits in (packing.Limits(), packing.Limits(tokens=512, segments=6, loss=200)):
        pieces = packing.pack_documents(docs.withColumn("bears", F.col("doc_id") % 2 == 0), WORD, limits, "bears").collect()
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for p in pieces:
            by_doc[p.doc_id].append(p)
            by_seq[p.sequence_id].append(p)
        for d in docs.collect():
            ids, at = np.array([*lib.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4"), 0
            for p in sorted(by_doc[d.doc_id], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
                at += p.length
            assert at == len(ids)
        for ps in by_seq.values():
            at = 0
            for p in sorted(ps, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= limits.tokens and len(ps) <= limits.segments and sum(p.length for p in ps if p.doc_id % 2 == 0) <= limits.loss
        if limits == packing.Limits():
            assert sum(p.length for p in pieces) > 0.97 * 4096 * len(by_seq)


# -- 9 ---------------------------------------------------------------------------------
def test_shards(spark):
    docs = spark.range(1003).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same é")).alias("text"))
    got = sharding.shard_documents(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        text = "same é" if r.doc_id % 3 else ""
        assert r.size == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode()) and r.law == "rows"
    assert set(by) == set(range(24)) and {len(s) for s in by.values()} <= {41, 42} and all(sorted(s) == list(range(len(s))) for s in by.values())
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_matrix_and_draws_are_exact():
    m = sharding.communication_matrix([5, 0, 900, 17], [300, 300, 322], 1)
    assert [sum(r) for r in m] == [5, 0, 900, 17] and [sum(c) for c in zip(*m, strict=True)] == [300, 300, 322]
    draw = random.Random(8)
    x = [sharding.hypergeometric(draw, 30, 70, 40) for _ in range(4000)]
    assert abs(np.mean(x) - 12) < 0.15 and abs(np.var(x) - 40 * 0.3 * 0.7 * 60 / 99) < 0.4
    assert 0 <= sharding.hypergeometric(draw, 10**10, 2 * 10**10, 10**6) <= 10**6


# -- pipeline --------------------------------------------------------------------------
def test_pipeline_equals_its_stages_by_hand(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    pages, known = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("pages", "labels"))
    kept = {r.doc_id for r in cotraining.score_documents(docs, pages, known).collect() if r.kept}
    one = docs.where(F.col("doc_id").isin(list(kept)))
    model = toxicity.fit(one, known)
    two = {r.doc_id: r.text for r in one.collect() if model is None or model.score([r.text])[0] < toxicity.THRESHOLD}
    comp = brute_components({i: shingles(t) for i, t in two.items()}, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b))
    want = {i for i, c in comp.items() if i == c}
    got = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == want and public_tokenizers.path("word_bpe_49k.json") == WORD


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    tidy = lambda d: sorted((r for r in d[cols].astype(object).where(d[cols].notna(), None).values.tolist()), key=str)
    assert tidy(got) == tidy(want)


def test_keys_of_a_part_meet_in_slices(monkeypatch):
    """The same candidates, members and counts as all at once, in memory a part's keys do not multiply."""
    import tracemalloc

    rng = np.random.default_rng(1)
    base, out = rng.integers(0, 1 << 63, 600).astype(np.uint64), parity_join._Emitter(1)
    rows = []
    for c in range(900):
        s = rng.integers(0, 1 << 63, 600).astype(np.uint64)
        if c % 9 == 0:
            s[5:] = base[5:]
        out.add(np.unique(s), c + 1)
        if out.n > 100_000:
            rows += out.flush()
    rows += out.flush()
    held = [(r[4], r[7], r[8], r[9], r[10]) for r in rows if r[1] == parity_join.KEYS]

    def found():
        pairs, members, counts = set(), set(), {}
        for part, kind, _, _, n, _, _, w, x, y, _ in parity_join._match(3, held):
            if kind == parity_join.PAIRS:
                pairs |= set(map(tuple, np.frombuffer(x, "<i8").reshape(-1, 2).tolist()))
            elif kind == parity_join.MEMBERS:
                low = np.frombuffer(w, "<u4").tolist()
                members |= {(part, k, c, i < n) for i, (k, c) in enumerate(zip(low, np.frombuffer(x, "<i8").tolist(), strict=True))}
            else:
                for c, *two in zip(*(np.frombuffer(v, t).tolist() for v, t in ((w, "<i8"), (x, "<i4"), (y, "<i4"))), strict=True):
                    counts[c] = [a + b for a, b in zip(counts.get(c, [0, 0]), two, strict=True)]
        return pairs, members, counts

    whole = found()
    assert len(whole[0]) >= 99 and whole[1] and whole[2]
    monkeypatch.setattr(parity_join, "SLICE_KEYS", 1 << 14)
    assert found() == whole
    tracemalloc.start()
    for _ in parity_join._match(3, held):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * sum(len(w) // 4 for _, w, _, _, _ in held)
