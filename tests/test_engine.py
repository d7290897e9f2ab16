import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echoform.functions import batches
from echoform.functions import kernels as K
from echoform.operators import cluster, evaluate, events, query, subseq
from echoform.plans import catalogue, engine
from echoform.plans.engine import Engine, from_table, load
from echoform.sources import series as sources
from echoform.streaming.matcher import match_stream

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def micro(spark):
    frame = pd.DataFrame([["A", 0, 2, 4, 2], ["B", 1, 3, 3, 1], ["C", 0, 2, 4, None]], columns=["id", "a", "b", "c", "d"])
    return from_table(spark, frame, 1)


@pytest.fixture(scope="module")
def events_engine(spark):
    return Engine(spark, catalogue.event_series(spark, DATA)).build(0.2, "eu", (16, 17))


def warp(x, y):
    t = np.full((len(x) + 1, len(y) + 1), np.inf)
    t[0, 0] = 0
    for i in range(len(x)):
        for j in range(len(y)):
            t[i + 1, j + 1] = abs(x[i] - y[j]) + min(t[i, j], t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_micro_fixture(micro, spark):
    assert micro.scale == (0.0, 4.0)
    rows = {r.series_id: r for r in micro.series.collect()}
    assert list(rows["A"].norm) == [0, 0.5, 1, 0.5] and rows["C"].n == 3
    micro.build(0.6, "eu", (2, 3), scheme="single", order="key")
    assert micro.num_windows() == 13 == micro.windows().count()
    sizes = [r.members for r in cluster.cluster_sizes(micro.clusters.where("len = 2")).orderBy("rep_start").collect()]
    assert sizes == [3, 3, 2]
    share = [round(r.score, 3) for r in micro.motif_all_length(False).where("len = 2").orderBy("place").collect()]
    assert share == [0.375, 0.375, 0.25]
    two = spark.createDataFrame([([0.0, 0.5, 1.0, 0.5], [0.25, 0.75, 0.75, 0.25])], "x array<double>, y array<double>")
    got = two.select(*[K.dtw(F.col("x"), F.col("y"), m) for m in ("eu", "ma", "ch")], K.distance(F.col("x"), F.col("y"), "eu"), K.lb_kim(F.col("x"), F.col("y"))).first()
    assert [round(v, 10) for v in got] == [0.3535533906, 0.125, 1.0, 0.25, 0.1767766953]


def test_overlap_and_paa(spark):
    row = spark.range(1).select(
        *[K.overlap(*map(F.lit, w)) for w in ((0, 10, 2, 5), (0, 4, 2, 6), (0, 4, 5, 9), (0, 4, 7, 9), (3, 5, 3, 5))], K.paa(F.lit([0.0, 1, 2, 3, 4, 5, 6]), 3)
    ).first()
    assert [round(v, 6) for v in row[:5]] == [0.363636, 0.428571, 0.0, -0.2, 1.0] and row[5] == [0.5, 2.5, 4.5]


def test_dtw_kernels_agree(spark):
    rng = np.random.default_rng(3)
    pairs = [(rng.random(rng.integers(1, 9)).tolist(), rng.random(rng.integers(1, 9)).tolist()) for _ in range(30)]
    df = spark.createDataFrame(pairs, "x array<double>, y array<double>")
    for m in ("eu", "ma", "ch"):
        rows = df.select("x", "y", batches.dtw_between(F.col("x"), F.col("y"), m).alias("a"), K.dtw(F.col("x"), F.col("y"), m).alias("b"), K.dtw_floor(F.col("x"), F.col("y"), m).alias("low")).collect()
        for r in rows:
            want = batches.normalise(np.float64(warp(r.x, r.y)), len(r.x), len(r.y), m)
            assert r.a == pytest.approx(want) == r.b and r.low <= r.a + 1e-12
    x, y = rng.random(40), rng.random(37)
    assert batches.dtw_fast(x, x) == 0 and batches.dtw_fast(x, y) >= warp(x, y) - 1e-12


def test_clusters_hold_invariants(events_engine):
    c = events_engine.clusters
    assert c.count() == events_engine.num_windows()
    assert c.where("dist_to_rep > 0.1").count() == 0
    reps = c.where("is_rep").count()
    assert reps == events_engine.num_clusters() == c.select(*cluster.REP).distinct().count()
    one = c.where("is_rep").first()
    assert events_engine.cluster_of(one.series_id, one.start, one.end).count() >= 1
    with pytest.raises(ValueError):
        events_engine.cluster_of("nobody", 0, 15)


@pytest.mark.parametrize("prefilter", ["none", "reference"])
@pytest.mark.parametrize("metric", ["eu", "ma", "ch"])
def test_leaders(prefilter, metric):
    data = np.random.default_rng(1).random((80, 5))
    rep, dist = cluster.leaders(data, 0.5, metric, "shuffle", prefilter)
    assert (dist <= 0.25).all() and all(rep[r] == r for r in set(rep.tolist()))
    if prefilter == "none":
        ids = sorted(set(rep.tolist()))
        assert all((cluster.distances(data[[j]], data[i], metric) > 0.25).all() for i in ids for j in ids if i < j)


def test_shuffle_is_the_seeded_one():
    want, draw = list(range(9)), random.Random(42)
    for i in range(8, 0, -1):
        j = draw.randint(0, i)
        want[i], want[j] = want[j], want[i]
    assert cluster.visiting_order(9, "shuffle") == want


def test_schemes_give_the_same_windows(events_engine):
    key = ["series_id", "start", "end"]
    base = events_engine.windows(False).select(*key)
    for scheme in subseq.SCHEMES:
        other = subseq.enumerate_windows(events_engine.series, 16, 17, scheme, 5, 15, None)
        assert evaluate.same_rows(base, other.select(*key))


def test_index_against_exact(events_engine):
    q = catalogue.first_query(events_engine)
    exact = [r.dist for r in events_engine.query_brute_force(q, 10).collect()]
    pruned = [r.dist for r in events_engine.query_brute_force(q, 10, prune=True).collect()]
    near = [r.dist for r in events_engine.query(q, 10).collect()]
    assert exact == pruned and len(near) == 10 and all(a >= b - 1e-12 for a, b in zip(near, exact, strict=True))
    assert evaluate.rank_error(events_engine.query(q, events_engine.num_windows()), events_engine.query_brute_force(q, events_engine.num_windows())).first().error == 0
    for mode in ("bsf", "heuristic"):
        assert events_engine.query(q, 5, lb_opt=mode).count() == 5


def test_filters_and_overlap(events_engine):
    q = catalogue.first_query(events_engine)
    assert events_engine.query(q, 5, exclude_same_id=True).where(F.col("series_id") == q.series_id).count() == 0
    got = events_engine.query(q, 6, overlap=0.5).collect()
    assert len(got) == 6 and not any(query.clash(a, b, 0.5) for i, a in enumerate(got) for b in got[:i])
    assert {r.series_id for r in events_engine.query(q, 5, id_filter=["3"], filter_mode="any", filter_stage="pre").collect()} == {"3"}
    assert {r.len for r in events_engine.query(q, 5, loi=(17, 17)).collect()} == {17}
    assert events_engine.motif(4, overlap=0.3).count() == 4


def test_errors(micro, spark):
    micro.build(0.6, "eu", (2, 3))
    bad = [
        lambda: micro.build(0), lambda: micro.build(1), lambda: micro.build(0.1, "cosine"), lambda: micro.build(0.1, loi=3), lambda: micro.build(0.1, loi=(9,)),
        lambda: micro.build(0.1, loi=(0, 2)), lambda: micro.build(0.1, loi=(3, 2)), lambda: micro.query([0.1, 0.2], 3, loi=(1, 2)), lambda: micro.query([0.1, 0.2], 99),
        lambda: micro.query([0.1], 1, id_filter=["A"]), lambda: micro.query([0.1], 1, overlap=2), lambda: micro.query("text", 1), lambda: micro.query([[1, 2]], 1),
        lambda: micro.query([], 1), lambda: micro.query_brute_force([0.1], 1, piecewise="paa"), lambda: micro.build_piecewise("dft"), lambda: micro.random_window(99),
        lambda: micro.predict_label_knn([0.1, 0.5], 1, 4), lambda: load(spark, "/no/such/place", 1), lambda: from_table(spark, np.array([["x", "y"]]), 0),
    ]
    for f in bad:
        with pytest.raises(ValueError):
            f()
    for f in (lambda: micro.query(5, 1), lambda: from_table(spark, pd.DataFrame({"a": [1]}), None), lambda: load(spark, 3)):
        with pytest.raises(TypeError):
            f()
    with pytest.raises(ValueError):
        Engine(spark, micro.series).num_windows()


def test_csv_ids_and_round_trip(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\t0.5\t1\t2\n1\t3\t\t4\n2\tNaN\t5\t6\n")
    e = load(spark, f"file://{tmp_path}/a.tsv", 1, header=False)
    assert e.has_uuid and e.num_series() == 3 and e.num_points() == 7 and e.scale == (0.5, 6.0)
    assert len({r.series_id for r in e.series.collect()}) == 3
    with pytest.raises(ValueError):
        (tmp_path / "b.csv").write_text("id,x\na,word\n")
        load(spark, f"file://{tmp_path}/b.csv", 1)
    e.build(0.3, "ma", (1, 2))
    e.save(f"file://{tmp_path}/db")
    back = load(spark, f"file://{tmp_path}/db")
    assert back.scale == e.scale and back.settings == e.settings and evaluate.same_rows(back.clusters.select(*cluster.REP), e.clusters.select(*cluster.REP))
    assert [r.dist for r in back.query([0.2, 0.4], 2).collect()] == [r.dist for r in e.query([0.2, 0.4], 2).collect()]
    label = e.predict_label_knn([0.2, 0.4], 1, 0)
    assert label in ("1", "2")
    assert sources.to_series(sources.read_table(spark, f"file://{tmp_path}/a.tsv", False), 1, rows=(1, 3))[0].count() == 2


def test_constant_and_short_series(spark):
    e = from_table(spark, pd.DataFrame([["a", 2.0, 2.0], ["b", 2.0, None]], columns=["i", "x", "y"]), 1).build(0.5, loi=(2,))
    assert e.num_windows() == 1 and list(e.series.where("series_id = 'a'").first().norm) == [0.0, 0.0]


def test_events_and_thinning(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], [3.0, 4.0, 5.0, 9.0, 9.0])], "v array<double>, e array<double>")
    at = df.withColumn("s", events.event_start(F.col("v"), F.col("e")))
    assert at.first().s == 2
    assert at.select(events.around(F.col("v"), F.col("s"), 1.0, 1, 2)[0]).first()[0] == [2.0, 3.0, 4.0]
    reps = spark.createDataFrame([(0, 1, 0, [0.0]), (0, 1, 1, [0.1]), (0, 1, 2, [0.9])], "bucket int, len int, pos int, data array<double>")
    assert [r.pos for r in cluster.thin_representatives(reps, 0.4, "ch").orderBy("pos").collect()] == [0, 2]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([5.0, 1, 2, 3, 9, 1, 2, 3])], "series_id string, pos long, value double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("series_id string, pos long, value double").parquet(f"{tmp_path}/in")
    q = match_stream(stream, [1.0, 2.0, 3.0], "ma", 0.01).writeStream.format("memory").queryName("hits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.start for r in spark.table("hits").collect()) == [1, 5]


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got, want = catalogue.queries()[name](spark, DATA).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    tidy = lambda d: sorted(([round(v, 5) if isinstance(v, float) else v for v in r] for r in d[cols].astype(object).where(d[cols].notna(), None).values.tolist()), key=str)
    assert tidy(got) == tidy(want)


@pytest.mark.parametrize("name", [
    "dss_buckets", "cluster_members", "cluster_meta", "cluster_filter", "motif_absolute", "index_query_orders", "index_query_loi", "index_query_ke", "index_query_radius",
    "index_query_excl_same", "index_query_idfilter_post", "nearest_cluster_query", "index_query",
])
def test_oracle_has_as_many_buckets_whatever_the_size(spark, name, monkeypatch):
    """A build of a larger table would plan for more buckets than the SQL has."""
    monkeypatch.setattr(cluster, "PLANNED_ROWS", 20)
    test_oracle(spark, name)


def test_long_series_are_clustered_as_far_as_the_sql_looks(spark, tmp_path):
    rows = spark.range(150).selectExpr("id o_orderkey", "id div 75 o_custkey", "cast(pmod(id * 37, 101) as double) o_totalprice", "timestamp_seconds(id) o_orderdate")
    rows.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    for name in ("cluster_meta", "cluster_members"):
        got, want = catalogue.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
        assert sorted(map(tuple, got[sorted(got)].values.tolist())) == sorted(map(tuple, want[sorted(got)].values.tolist())) and got["len"].max() == 64


@pytest.mark.parametrize("metric", ["eu", "ma", "ch"])
def test_groups_are_read_in_parts(spark, monkeypatch, metric):
    """As the whole group gives it, beyond the most that is held at once, ties included."""
    rng = np.random.default_rng(4)
    data = rng.integers(0, 9, (300, 3)) / 8
    data[100:160] = data[:60]
    rows = [(i % 2, 3, i // 2, f"s{i}", 0, 2, ["f"], x.tolist()) for i, x in enumerate(data)]
    windows = spark.createDataFrame(rows, "bucket int, len int, ts_idx long, series_id string, start int, end int, features array<string>, data array<double>").repartition(5)
    monkeypatch.setattr(cluster, "GROUP_ROWS", 2)
    monkeypatch.setattr(cluster, "STREAM_ROWS", 7)
    monkeypatch.setattr(cluster, "STREAM_PAIRS", 21)
    got = {r.series_id: r for r in cluster.build_clusters(windows, 0.5, metric, "key").collect()}
    for b in (0, 1):
        rep, dist = cluster.leaders(data[b::2], 0.5, metric, "key")
        for i, (r, d) in enumerate(zip(rep, dist, strict=True)):
            row = got[f"s{2 * i + b}"]
            assert (row.rep_series_id, row.is_rep, row.rep_start, row.rep_end) == (f"s{2 * r + b}", r == i, 0, 2) and row.dist_to_rep == pytest.approx(d, abs=1e-15)


def test_all_windows_of_orders_are_clustered(spark):
    n = [r["count"] for r in catalogue.table(spark, DATA, "orders").groupBy("o_custkey").count().collect()]
    c = catalogue.order_clusters(spark, DATA)
    assert c.count() == sum(k * (k + 1) // 2 for k in n) and c.select("series_id").distinct().count() == len(n)


def test_motif_across_takes_every_value(spark):
    """As separate engines give them, with scales of their own; null is a value."""
    rng = np.random.default_rng(8)
    ids = [f"v{i % 5}" if i % 5 else None for i in range(30)] + [f"w{i}" for i in range(1100)]
    rows = [(str(i), i, [v], (rng.random(7) * (i % 5 + 1)).tolist() if i < 30 else [0.0, 1.0], 7 if i < 30 else 2) for i, v in enumerate(ids)]
    frame = spark.createDataFrame(rows, "series_id string, ts_idx int, features array<string>, values array<double>, n int")
    shown = ["rank", "len", "series_id", "start", "end", "score"]
    for overlap in (1.0, 0.2):
        got = engine.motif_across(spark, frame, 0, 0.4, 4, (2, 3), overlap=overlap).collect()
        assert {r.value for r in got} == set(ids)
        for v in (None, "v1", "w7"):
            part = frame.where(F.element_at("features", 1).eqNullSafe(F.lit(v)))
            want = Engine(spark, part).build(0.4, loi=(2, 3) if v != "w7" else (2, 2)).motif(4, overlap).select(*shown).collect()
            assert sorted(tuple(r[c] for c in shown) for r in got if r.value == v) == sorted(map(tuple, want))


def test_batch_is_exact_whatever_the_blocks(spark, monkeypatch):
    """Against brute force; ties, several lengths, and blocks of two queries."""
    rng = np.random.default_rng(5)
    data = {str(i): rng.integers(0, 3, 4 + i % 3).astype(float).tolist() for i in range(60)}
    windows = spark.createDataFrame([(s, 0, len(d) - 1, len(d), d) for s, d in data.items()], "series_id string, start int, end int, len int, data array<double>").repartition(3)
    asked = {q: data[str(q)] for q in range(0, 60, 12)}
    queries = spark.createDataFrame([(q, d, str(q)) for q, d in asked.items()], "query_id int, qdata array<double>, qseries string")
    for metric, norm in (("eu", lambda c, n: np.sqrt(c / n)), ("ch", lambda c, n: c)):
        want = {q: sorted((round(float(norm(warp(d, x), len(d) + len(x))), 9), s) for s, x in data.items() if s != str(q))[:7] for q, d in asked.items()}
        for block in (2, 2000):
            monkeypatch.setattr(query, "QUERY_BLOCK", block)
            got = query.batch(windows, queries, 7, metric, True).orderBy("query_id", "rank").collect()
            assert {q: [(round(r.dist, 9), r.series_id) for r in got if r.query_id == q] for q in asked} == want
    assert query.batch(windows.where("false"), queries, 7, "eu").collect() == query.batch(windows, queries.where("false"), 7, "eu").collect() == []
