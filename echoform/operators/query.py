"""k-best-match queries: exact scans, compressed scans, the cluster index, and batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from echoform.functions import kernels as K
from echoform.functions.batches import KBest, dtw_many, dtw_to, normalise
from echoform.functions.kernels import check_metric
from echoform.operators.cluster import REP

ORDER = ["dist", "series_id", "start", "end"]
POINTER = ["series_id", "start", "end", "len"]
#: Queries of a batch that are held at once.
QUERY_BLOCK = 2000
MATCH = ["rank", "dist", "series_id", "start", "end", "len"]
_MATCH = "rank int, dist double, series_id string, start int, end int, len int"
LB_MODES = (False, None, "bsf", "heuristic")


@dataclass(frozen=True)
class Query:
    """A query's samples, and where they come from if they lie in the data."""

    data: tuple[float, ...]
    series_id: str | None = None


def check_query(k: int, id_filter, filter_mode, overlap: float, available: int | None = None, ke: int | None = None) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive integer")
    if id_filter is not None and filter_mode not in ("any", "all"):
        raise ValueError("id_filter needs filter_mode 'any' or 'all'")
    if not 0 <= overlap <= 1:
        raise ValueError("overlap must be between 0 and 1")
    if available is not None and (ke or k) > available:
        raise ValueError("ke exceeds the number of subsequences")


def id_condition(id_filter: list[str], mode: str) -> Column:
    """Windows whose ids hold any, or all, of the filter."""
    wanted = F.lit([str(x) for x in id_filter])
    return F.arrays_overlap("features", wanted) if mode == "any" else F.size(F.array_except(wanted, "features")) == 0


def restrict(rows: DataFrame, query: Query, exclude_same_id: bool, id_filter, filter_mode) -> DataFrame:
    if exclude_same_id and query.series_id is not None:
        rows = rows.where(F.col("series_id") != query.series_id)
    return rows.where(id_condition(list(id_filter), filter_mode)) if id_filter is not None else rows


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best of rows with dist, by (dist, series_id, start, end), with ranks from 1.
    The limit keeps k rows a task before they meet."""
    best = rows.select("dist", "series_id", "start", "end", "len").orderBy(*ORDER).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*ORDER))).select(*MATCH)


def clash(a, b, overlap: float) -> bool:
    """Whether two matches of one series overlap by at least ``overlap`` (signed Jaccard)."""
    if a["series_id"] != b["series_id"]:
        return False
    if (a["start"], a["end"]) == (b["start"], b["end"]):
        return True
    common = min(a["end"], b["end"]) - max(a["start"], b["start"]) + 1
    return common / (max(a["end"], b["end"]) - min(a["start"], b["start"]) + 1) >= overlap


def accept(rows: list, k: int, overlap: float, taken: list) -> list:
    """Greedily take sorted matches that clash with none taken, up to k in all."""
    out = list(taken)
    for r in rows:
        if len(out) >= k:
            break
        if not any(clash(r, t, overlap) for t in out):
            out.append(r)
    return out


def matches(spark, rows: list) -> DataFrame:
    rows = sorted(rows, key=lambda r: tuple(r[c] for c in ORDER))
    return spark.createDataFrame([(i + 1, r["dist"], r["series_id"], r["start"], r["end"], r["len"]) for i, r in enumerate(rows)], _MATCH)


def greedy(scored: DataFrame, k: int, overlap: float) -> DataFrame:
    """k best without overlaps. Only windows of one series can overlap, so a series' own
    greedy choice stands whatever others hold: each is reduced to k matches, and the best
    k of all are taken."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(ORDER, kind="stable").to_dict("records")
        return pd.DataFrame(accept(ordered, k, overlap, []), columns=list(rows.columns))

    columns = ["dist", "series_id", "start", "end", "len"]
    chosen = scored.select(*columns).groupBy("series_id").applyInPandas(run, "dist double, series_id string, start int, end int, len int")
    return ranked(chosen, k)


#: Windows warped side by side.
CHUNK = 16_384


def scan(series: DataFrame, query: Query, k: int, metric: str, lengths: tuple[int, int], exclude_same_id: bool = False, id_filter=None, filter_mode=None, overlap: float = 1.0, prune: bool = False) -> DataFrame:
    """Exact k best of all windows of series (series_id, features, norm, n), without
    enumerating them as rows: a task slides over its series and keeps the k best.

    ``prune`` warps only windows whose lower bound is within the k-th distance so far:
    the same answer. With ``overlap`` below 1, a series' matches are chosen greedily
    before they meet the others'."""
    check_query(k, id_filter, filter_mode, overlap)
    check_metric(metric)
    lo, hi = lengths
    q = np.asarray(query.data, float)

    def windows(flat: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(series, starts, windows) of one length, in chunks."""
        counts = np.maximum(np.diff(offsets) - size + 1, 0)
        owner = np.repeat(np.arange(len(counts)), counts)
        starts = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        view = np.lib.stride_tricks.sliding_window_view(flat, size) if len(flat) >= size else np.empty((0, size))
        for at in range(0, len(owner), CHUNK):
            o, s = owner[at : at + CHUNK], starts[at : at + CHUNK]
            yield o, s, view[offsets[o] + s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = KBest(k)
        for b in batches:
            ids, lists = b.column(0).to_pylist(), b.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]
            per: dict[int, list[dict]] = {}
            for size in range(lo, min(hi, int(np.diff(offsets).max(initial=0))) + 1):
                for owner, starts, data in windows(flat, offsets, size):
                    if overlap == 1.0:
                        best.search(data, q, metric, [ids[i] for i in owner], starts, prune)
                        continue
                    dist = normalise(dtw_many(data, q), size, len(q), metric)
                    for i in np.flatnonzero(dist <= best.limit):
                        per.setdefault(int(owner[i]), []).append({"dist": float(dist[i]), "series_id": ids[owner[i]], "start": int(starts[i]), "end": int(starts[i]) + size - 1, "len": size})
            for rows in per.values():
                rows.sort(key=lambda r: (r["dist"], r["start"], r["end"]))
                for r in accept([r for r in rows if r["dist"] <= best.limit], k, overlap, []):
                    best.add(np.array([r["dist"]]), [r["series_id"]], np.array([r["start"]]), r["len"])
        cols = list(zip(*best.rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["dist", "series_id", "start", "end", "len"])

    rows = restrict(series.where(F.col("n") >= lo), query, exclude_same_id, id_filter, filter_mode)
    return ranked(rows.select("series_id", "norm").mapInArrow(run, "dist double, series_id string, start int, end int, len int"), k)


def search_members(rows: DataFrame, query: Query, k: int, metric: str) -> DataFrame:
    """Best-so-far search: of rows (series_id, start, len, data), a task warps those whose
    bound is within its k-th distance so far."""
    q = np.asarray(query.data, float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = KBest(k)
        for f in frames:
            for size, part in f.groupby("len"):
                best.search(np.stack(part["data"].to_list()).astype(float), q, metric, part["series_id"].to_list(), part["start"].to_numpy())
        yield pd.DataFrame(best.rows, columns=["dist", "series_id", "start", "end", "len"])

    return ranked(rows.select("series_id", "start", "len", "data").mapInPandas(run, "dist double, series_id string, start int, end int, len int"), k)


def brute_force(windows: DataFrame, query: Query, k: int, metric: str, exclude_same_id: bool = False, id_filter=None, filter_mode=None, overlap: float = 1.0, mode: str = "exact") -> DataFrame:
    """k best of a table of windows (series_id, start, end, len, data, features), by exact
    or (``mode='fast'``) approximate warping."""
    check_query(k, id_filter, filter_mode, overlap)
    rows = restrict(windows, query, exclude_same_id, id_filter, filter_mode)
    scored = rows.withColumn("dist", dtw_to(list(query.data), metric, mode)("data"))
    return ranked(scored, k) if overlap == 1.0 else greedy(scored, k, overlap)


def piecewise(windows: DataFrame, query: Query, k: int, metric: str, kind: str, segments: int, compressed: str | None = None, exclude_same_id: bool = False, id_filter=None, filter_mode=None, overlap: float = 1.0, mode: str = "exact") -> DataFrame:
    """Choose k windows, of those the filters leave, by warping PAA or SAX forms, then rank
    those by their true distance, and drop later ones that overlap."""
    check_query(k, id_filter, filter_mode, overlap)
    form = {"paa": lambda x: K.paa(x, segments), "sax": lambda x: K.sax(x, segments)}.get(kind)
    if form is None:
        raise ValueError("piecewise mode must be 'paa' or 'sax'")
    q = windows.sparkSession.range(1).select(form(F.lit([float(v) for v in query.data])).cast("array<double>")).first()[0]  # one short array
    x = F.col(compressed) if compressed else form(F.col("data")).cast("array<double>")
    # the generator keeps the planner from inlining a lambda into the UDF's argument, which it cannot run
    open_to = restrict(windows, query, exclude_same_id, id_filter, filter_mode)
    rough = open_to.withColumn("_form", F.explode(F.array(x))).withColumn("dist", dtw_to(q, metric)("_form"))
    chosen = rough.select("dist", "series_id", "start", "end", "len", "data").orderBy(*ORDER).limit(k)
    scored = chosen.withColumn("dist", dtw_to(list(query.data), metric, mode)("data"))
    return ranked(scored, k) if overlap == 1.0 else greedy(scored, k, overlap)


def batch(windows: DataFrame, queries: DataFrame, k: int, metric: str, exclude_same_id: bool = False) -> DataFrame:
    """k best of every query (query_id, qdata, qseries) among all windows.

    Queries are dealt by hash into blocks of about QUERY_BLOCK, each scanned against the
    windows in turn; a task keeps k rows a query, and only those are shuffled on query_id.
    Repeated query ids must carry equal data."""
    check_metric(metric)
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    schema = StructType([queries.schema["query_id"], StructField("dist", DoubleType()), *(windows.schema[c] for c in POINTER)])
    place, found = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)), []
    for i in range(n_blocks):
        block = queries.where(place == i).select("query_id", "qdata", "qseries").distinct().collect()  # about QUERY_BLOCK
        scan = windows.select(*POINTER, "data").mapInPandas(_best_of_block(block, k, metric, exclude_same_id), schema)
        best = scan.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*ORDER))).where(F.col("rank") <= k)
        if n_blocks > 1:  # lets go of the block before the next is read
            shared_checkpoints(windows.sparkSession)
            best = best.checkpoint()
        found.append(best)
    return reduce(DataFrame.unionByName, found).select("query_id", *MATCH)


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go where the cluster says; to a folder of our own only where it says
    nothing and there is one machine."""
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="echoform-"))


def _best_of_block(block: list, k: int, metric: str, exclude_same_id: bool):
    """A scan of window batches that ends with each query's k best of the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[pd.DataFrame | None] = [None] * len(block)
        for b in batches:
            if b.empty:
                continue
            sizes = b["data"].map(len).to_numpy()
            groups = [(b.iloc[at].drop(columns="data"), np.stack(b["data"].iloc[at].to_list()).astype(float)) for at in (np.flatnonzero(sizes == n) for n in np.unique(sizes))]
            for i, q in enumerate(block):
                query = np.asarray(q.qdata, float)
                for rows, data in groups:
                    dist = normalise(dtw_many(data, query), data.shape[1], len(query), metric)
                    open_to = (rows["series_id"] != q.qseries).to_numpy() if exclude_same_id else np.ones(len(rows), bool)
                    if best[i] is not None and len(best[i]) == k:
                        open_to &= dist <= best[i]["dist"].iloc[-1]
                    if open_to.sum() > k:
                        open_to &= dist <= np.partition(dist[open_to], k - 1)[k - 1]
                    if open_to.any():
                        found = rows[open_to].assign(dist=dist[open_to])
                        best[i] = (found if best[i] is None else pd.concat([best[i], found])).sort_values(ORDER, kind="stable").head(k)
        for q, rows in zip(block, best, strict=True):
            if rows is not None:
                yield rows.assign(query_id=q.query_id)[["query_id", "dist", *POINTER]]

    return run


def select_candidates(clusters: DataFrame, reps: DataFrame, query_len: int, k: int, ke: int, radius: int) -> DataFrame:
    """Members of the representatives the index search opens.

    clusters: member rows after any overlap removal; reps: representatives with ``d_rep``
    and ``last``, which puts a representative behind all others of its bucket and length.
    In each (bucket, len) representatives open by distance while fewer than k members came
    before; in each bucket lengths open in rings around the query's while fewer than ke
    members came from nearer rings."""
    sizes = clusters.groupBy(*REP).agg(F.count("*").alias("size"))
    sized = reps.join(sizes, REP, "left").withColumn("size", F.coalesce("size", F.lit(0)))
    before = Window.partitionBy("bucket", "len").orderBy("last", "d_rep", "rep_series_id", "rep_start").rowsBetween(Window.unboundedPreceding, -1)
    opened = sized.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("before") < k)
    ring = F.greatest(F.lit(0), F.abs(F.col("len") - query_len) - radius)
    rings = opened.groupBy("bucket", "len").agg(F.sum("size").alias("found")).withColumn("ring", ring)
    nearer = Window.partitionBy("bucket").orderBy("ring").rangeBetween(Window.unboundedPreceding, -1)
    kept = rings.withColumn("nearer", F.coalesce(F.sum("found").over(nearer), F.lit(0))).where(F.col("nearer") < ke).select("bucket", "len")
    return clusters.join(opened.join(kept, ["bucket", "len"]).select(*REP), REP)


def index_query(clusters: DataFrame, data_of, query: Query, k: int, metric: str, lengths: tuple[int, int], ke: int | None = None, radius: int = 1, exclude_same_id: bool = False,
                id_filter=None, filter_mode=None, overlap: float = 1.0, filter_stage: str = "post", lb: str | bool | None = False, st: float = 1.0) -> DataFrame:
    """Approximate k best through the clusters; ``data_of`` attaches samples to pointers.

    ``filter_stage='pre'`` applies id filters before members are counted. ``lb``: 'bsf'
    opens representatives whose end-point or envelope bound exceeds st only where the
    others hold fewer than k members, and warps members only while their bound is within
    the k-th distance so far; 'heuristic' keeps
    the best three quarters by the first and a quarter of those by the second. With
    overlap below 1 rounds repeat until k matches stand or a round adds none."""
    check_query(k, id_filter, filter_mode, overlap)
    if lb not in LB_MODES:
        raise ValueError(f"lb must be one of {LB_MODES}")
    ke, q = ke or k, F.lit([float(v) for v in query.data])
    members = clusters.where(F.col("len").between(*lengths))
    reps = members.where("is_rep").select(*REP, F.col("rep_series_id").alias("series_id"), F.col("rep_start").alias("start"))
    reps = data_of(reps)
    if lb:
        fitted = K.resample(F.col("data"), len(query.data))
        reps = reps.withColumn("_kim", K.lb_kim(F.col("data"), q)).withColumn("_keogh", K.lb_keogh(fitted, q))
        if lb == "bsf":
            reps = reps.withColumn("last", (F.col("_kim") > st) | (F.col("_keogh") > st) | (K.lb_keogh(q, fitted) > st))
        else:
            w = Window.partitionBy("bucket", "len")
            share = lambda c: F.row_number().over(w.orderBy(c, "rep_series_id", "rep_start")) / F.count("*").over(w)
            first = lambda x: F.row_number().over(w.orderBy(x, "rep_series_id", "rep_start")) == 1
            reps = reps.withColumn("_s", share("_kim")).withColumn("_f", first("_kim")).where("_s <= 0.75 or _f").withColumn("_s", share("_keogh")).withColumn("_f", first("_keogh")).where("_s <= 0.25 or _f")
    reps = reps if lb == "bsf" else reps.withColumn("last", F.lit(False))
    reps = reps.withColumn("d_rep", dtw_to(list(query.data), metric)("data")).select(*REP, "d_rep", "last")
    reps = reps.persist() if overlap < 1 else reps
    to_query, taken = dtw_to(list(query.data), metric), []
    while True:
        rows = members
        if filter_stage == "pre":
            rows = restrict(rows, query, exclude_same_id, id_filter, filter_mode)
        if taken:
            prev = F.broadcast(clusters.sparkSession.createDataFrame([(r["series_id"], r["start"], r["end"]) for r in taken], "_id string, _s int, _e int"))  # at most k rows
            rows = rows.join(prev, K.overlaps(F.col("series_id"), F.col("start"), F.col("end"), F.col("_id"), F.col("_s"), F.col("_e"), overlap), "left_anti")
        found = select_candidates(rows, reps, len(query.data), k, ke, radius)
        found = restrict(found, query, exclude_same_id, id_filter, filter_mode)
        found = data_of(found.select("bucket", "series_id", "start", "end", "len"))
        if overlap == 1.0 and lb == "bsf":
            return search_members(found, query, k, metric)
        scored = found.withColumn("dist", to_query("data"))
        if overlap == 1.0:
            return ranked(scored, k)
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(*ORDER))
        best = scored.withColumn("_r", place).where(F.col("_r") <= k).select("dist", "series_id", "start", "end", "len").collect()  # k rows a bucket
        more = accept(sorted(best, key=lambda r: tuple(r[c] for c in ORDER)), k, overlap, taken)
        if len(more) == len(taken) or len(more) >= k:
            reps.unpersist()
            return matches(clusters.sparkSession, more)
        taken = more


def nearest_cluster(clusters: DataFrame, data_of, query: Query, k: int, metric: str, lengths: tuple[int, int]) -> DataFrame:
    """k best members of the one cluster whose representative is nearest (see ``index_query``)."""
    check_query(k, None, None, 1.0)
    to_query, members = dtw_to(list(query.data), metric), clusters.where(F.col("len").between(*lengths))
    reps = data_of(members.where("is_rep").select(*REP, F.col("rep_series_id").alias("series_id"), F.col("rep_start").alias("start")))
    nearest = reps.withColumn("d_rep", to_query("data")).orderBy("d_rep", "rep_series_id", "rep_start", "len", "bucket").select(*REP).limit(1)
    found = data_of(members.join(F.broadcast(nearest), REP).select("series_id", "start", "end", "len"))  # a row is broadcast
    return ranked(found.withColumn("dist", to_query("data")), k)


def vote(found: DataFrame, series: DataFrame, label_place: int) -> DataFrame:
    """One row (label, votes): the commonest label of the matches' series, null on a tie."""
    labels = found.join(series.select("series_id", F.element_at("features", label_place + 1).alias("label")), "series_id").groupBy("label").agg(F.count("*").alias("votes"))
    top = labels.agg(F.max("votes").alias("votes"), F.sort_array(F.collect_list(F.struct("votes", "label")), asc=False).alias("all"))
    tied = (F.size("all") > 1) & (F.element_at("all", 1)["votes"] == F.try_element_at(F.col("all"), F.lit(2))["votes"])
    return top.select(F.when(~tied, F.element_at("all", 1)["label"]).alias("label"), "votes")


def batch_vote(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Per query of a batch: its commonest label (series_id, label), null on a tie."""
    votes = found.join(labels, "series_id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("query_id").orderBy(F.desc("votes"), "label")
    two = votes.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("votes").over(w)).where("r = 1")
    return two.select("query_id", F.when(F.col("next").isNull() | (F.col("next") < F.col("votes")), F.col("label")).alias("label"), "votes")


def motifs(scores: DataFrame, k: int, overlap: float = 1.0, of: str | None = None) -> DataFrame:
    """The k most representative windows of all lengths (see ``representativeness``),
    optionally without overlaps, with ranks from 1; of each value of the column ``of``, if
    given, whose series are its own."""
    check_query(k, None, None, overlap)
    keys = [F.desc("score"), F.asc("len"), F.asc("rep_series_id"), F.asc("rep_start"), F.asc("bucket")]
    group, shown = [of] if of else [], ["rank", "len", "series_id", "start", "end", "score"]
    rows = scores.select(*group, "len", F.col("rep_series_id").alias("series_id"), F.col("rep_start").alias("start"), F.col("rep_end").alias("end"), "score", "bucket", "rep_series_id", "rep_start")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["score", "len", "rep_series_id", "rep_start", "bucket"], ascending=[False, True, True, True, True], kind="stable")
        return pd.DataFrame(accept(ordered.to_dict("records"), k, overlap, []), columns=list(pdf.columns))

    if overlap < 1.0:  # a series' own greedy choice stands
        rows = rows.groupBy("series_id").applyInPandas(run, rows.schema)
    best = rows if of else rows.orderBy(*keys).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*keys))).where(F.col("rank") <= k).select(*group, *shown)
