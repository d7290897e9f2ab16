"""Accessors, readers, options and evaluation that no registered query goes through."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echoform.functions import kernels as K
from echoform.functions.batches import KBest, dtw_many, floors, normalise
from echoform.operators import cluster, evaluate, events, query, subseq
from echoform.plans import catalogue
from echoform.plans.engine import Engine, from_table, load, prepare_folder, session_settings
from echoform.sources import series as sources
from echoform.sources import store


@pytest.fixture(scope="module")
def some(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame([[f"s{i}", "ab"[i % 2], *rng.random(12).round(3)] for i in range(14)], columns=["id", "kind", *map(str, range(12))])
    return from_table(spark, frame, 2).build(0.3, "eu", (4, 6), order="key")


def plain_matches(e, q, metric, lengths, k, overlap=1.0, skip=()):
    rows = []
    for r in e.series.collect():
        for size in range(lengths[0], lengths[1] + 1):
            for s in range(r.n - size + 1):
                if r.series_id not in skip:
                    cost = dtw_many(np.array([r.norm[s : s + size]]), np.array(q))[0]
                    rows.append({"dist": float(normalise(cost, size, len(q), metric)), "series_id": r.series_id, "start": s, "end": s + size - 1, "len": size})
    rows.sort(key=lambda r: (r["dist"], r["series_id"], r["start"], r["end"]))
    return query.accept(rows, k, overlap, []) if overlap < 1 else rows[:k]


def key(rows):
    return [(round(r["dist"], 9), r["series_id"], r["start"], r["end"]) for r in rows]


@pytest.mark.parametrize("metric", ["eu", "ma", "ch"])
def test_scan_equals_a_plain_loop(some, metric):
    e = Engine(some.spark, some.series).build(0.3, metric, (4, 6), group_only=True)
    q = query.Query((0.2, 0.9, 0.4, 0.6, 0.1), "s3|b")
    for options in ({}, {"prune": True}, {"overlap": 0.3}, {"exclude_same_id": True, "overlap": 0.0}):
        want = plain_matches(e, q.data, metric, (4, 6), 9, options.get("overlap", 1.0), {"s3|b"} if "exclude_same_id" in options else ())
        assert key(e.query_brute_force(q, 9, **options).orderBy("rank").collect()) == key(want)
    fast = e.query_brute_force(q, 3, mode="fast").collect()
    assert len(fast) == 3 and min(r.dist for r in fast) >= plain_matches(e, q.data, metric, (4, 6), 1)[0]["dist"] - 1e-12


def test_bounds_hold_and_best_keeps_ties():
    rng = np.random.default_rng(1)
    c, q = rng.random((200, 7)), rng.random(5)
    for metric in ("eu", "ma", "ch"):
        assert (floors(c, q, metric) <= normalise(dtw_many(c, q), 7, 5, metric) + 1e-12).all()
    best = KBest(3)
    best.add(np.array([1.0, 0.5, 0.5, 0.5]), ["d", "c", "b", "a"], np.zeros(4, int), 2)
    assert [r[1] for r in best.rows] == ["a", "b", "c"] and best.limit == 0.5
    best.add(np.array([0.5]), ["0"], np.zeros(1, int), 2)
    assert [r[1] for r in best.rows] == ["0", "a", "b"]


def test_options_reach_compressed_scans(some):
    q = query.Query(tuple(some.window_data("s2|a", 0, 4)), "s2|a")
    some.build_piecewise("paa", 2)
    for built in (True, False):
        run = lambda **o: some.query_brute_force(q, 5, piecewise="paa", use_built_piecewise=built, **o).collect()  # noqa: B023, E731
        assert any(r.series_id == "s2|a" for r in run())
        assert not any(r.series_id == "s2|a" for r in run(exclude_same_id=True))
        assert {r.series_id for r in run(id_filter=["s4", "s6"], filter_mode="any")} <= {"s4|a", "s6|a"}
        apart = run(overlap=0.0)
        assert not any(query.clash(a, b, 0.0) for i, a in enumerate(apart) for b in apart[:i])
    with pytest.raises(ValueError):
        some.query_brute_force(q, 5, piecewise="paa", prune=True)


def test_best_so_far_never_returns_fewer(some):
    q = query.Query((9.0, -9.0, 9.0, -9.0, 9.0))  # every representative's bound exceeds st
    got = some.query(q, 6, lb_opt="bsf").collect()
    assert len(got) == 6 and key(sorted(got, key=lambda r: r.rank)) == key(some.query(q, 6).orderBy("rank").collect())


def test_overlapping_rounds_of_the_index(some):
    q = query.Query((0.2, 0.9, 0.4, 0.6, 0.1))
    got = some.query(q, 8, overlap=0.2).orderBy("rank").collect()
    assert len(got) == 8 and not any(query.clash(a, b, 0.2) for i, a in enumerate(got) for b in got[:i])
    all_open = some.query(q, some.num_windows(), ke=some.num_windows())
    assert key(all_open.orderBy("rank").collect()) == key(plain_matches(some, q.data, "eu", (4, 6), some.num_windows()))


def test_accessors(some):
    assert some.whole_series().count() == 14 and some.has_id("s1|b") and not some.has_id("s1")
    assert some.has_window("s1|b", 0, 11) and not some.has_window("s1|b", 0, 12) and not some.has_window("s1|b", 3, 2)
    assert some.denormalise(some.normalise([0.1, 0.7])) == pytest.approx([0.1, 0.7])
    assert some.windows_of_len(5).count() == 14 * 8
    drawn = some.random_window(6, seed=3)
    assert drawn["data"] == pytest.approx(some.window_data(drawn["series_id"], drawn["start"], drawn["end"])) and drawn == some.random_window(6, seed=3)
    c = some.clusters
    halves = cluster.merge_clusters(c.where("len = 4"), c.where("len > 4"))
    assert halves.count() == c.count() == cluster.cluster_counts(c).agg(F.sum("members")).first()[0]
    assert {r.feature for r in cluster.feature_list(c).collect()} == {f"s{i}" for i in range(14)} | {"a", "b"}
    assert {r.len for r in cluster.representatives(c, (5, 6)).collect()} == {5, 6}
    lengths = c.select("len").distinct()
    assert {r.len for r in subseq.lengths_within(lengths, 7, 2).collect()} == {5, 6}
    assert some.predict_label_knn(("s2|a", 0, 4), 3, 1) in ("a", "b")


def test_names_and_inner_windows(spark):
    row = spark.range(1).select(K.name_of(F.lit("a b|c"), F.lit(2), F.lit(5)), *K.sub_window(F.lit(2), F.lit(9), 1, -2)).first()
    assert tuple(row) == ("(a-b)_(c): (2:5)len=4", 3, 7)
    with pytest.raises(IndexError):
        K.sub_window(F.lit(1), F.lit(2), -1, 0)


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,a,b,c\nx,1,2,0\ny,3,0,4\nz,0,0,0\n")
    got = {r.series_id: list(r["values"]) for r in sources.read_trimmed(spark, f"file://{tmp_path}/t.csv", 1).collect()}
    assert got == {"x": [1, 2], "y": [3, 0, 4], "z": []}
    (tmp_path / "q.csv").write_text("lab,1,2,\nlab,3,,\n")
    raw = sources.read_raw_queries(spark, f"file://{tmp_path}/q.csv", 1)
    assert {r.query_id: list(r.data) for r in raw.collect()} == {0: [1, 2], 1: [3]}
    e = from_table(spark, pd.DataFrame([["p", 0.0, 2.0, 4.0], ["q", 4.0, 2.0, 0.0]], columns=["i", "x", "y", "z"]), 1).build(0.5, loi=(2, 3), group_only=True)
    assert e.queries_of(raw).orderBy("query_id").first().qdata == [0.25, 0.5]
    assert {r.query_id for r in e.query_batch(e.queries_of(raw), 1).collect()} == {0, 1}
    at = spark.createDataFrame([(0, "p", 1, 2), (1, "p", 1, 9)], "query_id long, series_id string, start int, end int")
    assert [list(r.qdata) for r in e.queries_at(at).collect()] == [[0.5, 1.0]]
    for name, cells in (("one", "1\t2\t3\n"), ("two", "1\t2\n" * 9)):
        (tmp_path / "ucr" / name).mkdir(parents=True)
        (tmp_path / "ucr" / name / f"{name}_TRAIN.tsv").write_text(cells)
    root = f"file://{tmp_path}/ucr"
    assert [f.rsplit("/", 1)[-1] for f in sources.training_files(spark, root)] == ["one_TRAIN.tsv", "two_TRAIN.tsv"] and len(sources.training_files(spark, root, 10)) == 1
    (tmp_path / "pairs").mkdir()
    for f in ("a", "a_q", "b", "b_q"):
        (tmp_path / "pairs" / f).write_text("1\n")
    assert [tuple(x.rsplit("/", 1)[-1] for x in p) for p in sources.paired_files(spark, f"file://{tmp_path}/pairs")] == [("a", "a_q"), ("b", "b_q")]
    gaps = spark.createDataFrame([("u", 40), ("v", 7)], "series_id string, ts_idx long")
    assert {r.series_id: r.ts_idx for r in sources.ordinal(gaps).collect()} == {"v": 0, "u": 1}


def test_ids_are_told_apart(spark):
    rows = [("a|b", "c", 1, 1.0), ("a", "b|c", 1, 2.0), (None, "c", 1, 3.0), ("", "c", 1, 4.0), ("a\\", "c", 1, 5.0)]
    log = spark.createDataFrame(rows, "k string, j string, t int, v double")
    s = sources.from_events(log, ["k", "j"], ["t"], "v")
    assert s.select("series_id").distinct().count() == 5 and s.select("ts_idx").distinct().count() == 5
    assert Engine(spark, s).build(0.5, loi=(1,)).num_clusters() >= 1


def test_events_results_and_folders(spark, some, tmp_path):
    s = spark.createDataFrame([(["n", "go", "c", "1000", "2500"], [1.0])], "features array<string>, values array<double>")
    assert events.to_events(s).first()[:3] == ("go", 1.0, 2.5)
    found = some.query((0.1, 0.5, 0.3, 0.2), 3)
    store.write_results(found, f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").count() == 3
    (tmp_path / "r.csv").write_text("\n".join(f"i{k},{k},2,3,4,5" for k in range(3)) + "\n")
    saved = prepare_folder(spark, [f"file://{tmp_path}/r.csv"], 1, f"file://{tmp_path}/dbs", 1.5, (1.5, 2.5))
    assert load(spark, saved[0]).settings["loi"] == [2, 3]


def test_evaluation(spark, some):
    assert evaluate.length_bands(2, 12) == [(2, 4), (6, 7), (9, 11)] or len(evaluate.length_bands(2, 12)) == 3
    drawn = evaluate.query_set(some, some, (4, 6), 3)
    assert {kind for kind, _ in drawn} == {"train", "test"} and len(drawn) == 6
    q = query.Query((0.2, 0.9, 0.4, 0.6))
    errors = evaluate.sweep(some, q, 3, 3)
    assert [ke for ke, _ in errors] == sorted(ke for ke, _ in errors) and all(x >= 0 for _, x in errors)
    arms = evaluate.timed_arms(some, [q], 3, {"exact": lambda e, q, k: e.query_brute_force(q, k)})
    assert arms[0]["error"] == 0 and arms[0]["seconds"] > 0
    df = spark.createDataFrame([(1.0, 2.0), (1.4, 4.0), (2.2, 8.0)], "x double, y double")
    assert {(r.bin, r["mean"], r.n) for r in evaluate.binned(df, "x", "y", 1.0).collect()} == {(1.0, 3.0, 2), (2.0, 8.0, 1)}


def test_buckets_follow_the_data(spark, monkeypatch):
    s = catalogue.event_series(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(cluster, "PLANNED_ROWS", 50)
    e = Engine(spark, s).build(0.2, loi=(16, 17))
    assert e.settings["n_buckets"] == -(-sum(r.n - 15 for r in s.collect()) // 50) > 8
    monkeypatch.setattr(cluster, "GROUP_ROWS", 2)
    with pytest.raises(Exception, match="more buckets"):
        Engine(spark, s).build(0.2, loi=(16, 16), n_buckets=8).num_clusters()


def plain_warm(rows, st):
    """Clusters of rows ((series, start, size) -> samples), visited in key order, longest first."""
    gap = lambda a, b: float(np.sqrt(np.mean((np.array(rows[a]) - np.array(rows[b])) ** 2)))
    out, before = {}, {}
    for size in sorted({k[2] for k in rows}, reverse=True):
        choices = []
        for cut in (0, 1):
            trim = lambda w: (w[0], w[1] + cut, w[2] - 1)  # noqa: B023, E731
            heads = [trim(r) for r in before if before[r] == r and trim(r) in rows]
            kept = [h for i, h in enumerate(heads) if all(gap(h, g) > st / 2 for g in heads[:i])]
            choices.append((kept, {trim(w): trim(r) for w, r in before.items() if trim(w) in rows and trim(r) in kept and gap(trim(w), trim(r)) <= st / 2}))
        kept, now = choices[1] if len(choices[1][0]) > len(choices[0][0]) else choices[0]
        reps = list(kept)
        for w in sorted(k for k in rows if k[2] == size):
            if w not in now:
                near = min(reps, key=lambda r: gap(r, w), default=None)  # noqa: B023
                now[w] = near if near and gap(near, w) <= st / 2 else w
                reps += [w] if now[w] == w else []
        before = {w: now[w] for w in sorted(now)}
        out |= before
    return out


@pytest.mark.parametrize("scheme", ["single", "dss"])
def test_warm_clusters_equal_a_plain_version(some, scheme):
    e = Engine(some.spark, some.series).build(0.5, "eu", (3, 6), order="key", scheme=scheme, warm=True)
    got = e.clusters.collect()
    assert len(got) == e.num_windows() and max(r.dist_to_rep for r in got) <= 0.25
    buckets = {}
    for w in e.windows().collect():
        buckets.setdefault(w.bucket, {})[w.series_id, w.start, w.len] = list(w.data)
    names = {r.series_id: r.ts_idx for r in e.series.collect()}
    for b, rows in buckets.items():
        by_place = {(names[s], a, n): x for (s, a, n), x in rows.items()}
        want = plain_warm(by_place, 0.5)
        assert {(names[r.series_id], r.start, r.len): (names[r.rep_series_id], r.rep_start, r.len) for r in got if r.bucket == b} == want
    cold = Engine(some.spark, some.series).build(0.5, "eu", (3, 6), order="key", scheme=scheme)
    assert e.clusters.where("len = 6").exceptAll(cold.clusters.where("len = 6")).count() == 0


def test_nearest_cluster_and_session(some):
    q = query.Query((0.2, 0.9, 0.4, 0.6, 0.1))
    reps = some.clusters.where("is_rep and len = 5").select("series_id", "start", "bucket").collect()
    cost = {(r.series_id, r.start): float(normalise(dtw_many(np.array([some.window_data(r.series_id, r.start, r.start + 4)]), np.array(q.data))[0], 5, 5, "eu")) for r in reps}
    best = min(cost, key=lambda r: (cost[r], r))
    members = {(r.series_id, r.start) for r in some.cluster_of(*best, best[1] + 4).collect()}
    got = some.query_nearest(q, 1000, (5, 5)).orderBy("rank").collect()
    assert {(r.series_id, r.start) for r in got} == members and [r.dist for r in got] == sorted(r.dist for r in got)
    assert session_settings(some.spark)["parallelism"] == 4 and session_settings(some.spark)["spark.driver.memory"] == "4g"
