"""The engine: load, build, query, motif, label, compress, save."""

from __future__ import annotations

import random
import warnings
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoform.functions import kernels as K
from echoform.operators import cluster, query, subseq
from echoform.sources import series as sources
from echoform.sources import store


class Engine:
    """A set of series on a common scale, and, once built, its windows and clusters.

    ``build`` sets a new index as a whole; nothing of an earlier one remains."""

    def __init__(self, spark: SparkSession, series: DataFrame, has_uuid: bool = False, scale: tuple[float, float] | None = None):
        self.spark, self.has_uuid = spark, has_uuid
        # Read and grouped once; dealt evenly, for few partitions of short rows expand to very many windows.
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.base = series.drop("norm").repartition(parts, "series_id").persist()
        self.scale = scale or subseq.scale_of(self.base)
        self.series = subseq.normalised(self.base, *self.scale)
        self.settings: dict = {}
        self.clusters: DataFrame | None = None
        self.pieces: DataFrame | None = None

    # -- accessors ---------------------------------------------------------------
    def num_series(self) -> int:
        return self.series.count()

    def num_points(self) -> int:
        return self.series.agg(F.sum("n")).first()[0] or 0

    def max_len(self) -> int:
        return self.series.agg(F.max("n")).first()[0] or 0

    def lengths(self) -> DataFrame:
        return self.series.select("series_id", "n")

    def stats(self) -> DataFrame:
        return self.series.agg(F.count("*").alias("series"), F.sum("n").alias("points"), F.max("n").alias("longest"), F.median("n").alias("median_len"))

    def whole_series(self) -> DataFrame:
        return self.series.select("series_id", F.lit(0).alias("start"), (F.col("n") - 1).alias("end"), "norm")

    def has_id(self, series_id: str) -> bool:
        return bool(self.series.where(F.col("series_id") == series_id).limit(1).count())

    def has_window(self, series_id: str, start: int, end: int) -> bool:
        return 0 <= start <= end and bool(self.series.where((F.col("series_id") == series_id) & (F.col("n") > end)).limit(1).count())

    def window_data(self, series_id: str, start: int, end: int, normalised: bool = True) -> list[float]:
        row = self.series.where(F.col("series_id") == series_id).select(K.window(F.col("norm" if normalised else "values"), F.lit(start), F.lit(end - start + 1)).alias("d"), "n").first()
        if row is None or not 0 <= start <= end < row.n:
            raise ValueError(f"no window {series_id} [{start}, {end}]")
        return list(row.d)

    def random_window(self, size: int, seed: int = 42, normalised: bool = True) -> dict:
        """A seeded choice of a long enough series and of a start in it."""
        if size < 1:
            warnings.warn("length below 1 taken as 1", stacklevel=2)
            size = 1
        fits = self.series.where(F.col("n") >= size)
        pick = fits.orderBy(F.xxhash64("series_id", F.lit(seed)), "series_id").select("series_id", "n", "norm" if normalised else "values").first()
        if pick is None:
            raise ValueError(f"no series has {size} samples")
        start = random.Random(seed).randint(0, pick.n - size)
        return {"series_id": pick.series_id, "start": start, "end": start + size - 1, "data": list(pick[2][start : start + size])}

    def normalise(self, data: Iterable[float]) -> list[float]:
        lo, hi = self.scale
        return [(float(v) - lo) / (hi - lo) if hi > lo else 0.0 for v in data]

    def denormalise(self, data: Iterable[float]) -> list[float]:
        lo, hi = self.scale
        return [float(v) * (hi - lo) + lo for v in data]

    # -- building ----------------------------------------------------------------
    def build(self, st: float, dist_type: str = "eu", loi=None, scheme: str = "dss", n_buckets: int | None = None, order: str = "shuffle", prefilter: str = "none", group_only: bool = False, warm: bool = False) -> Engine:
        """Enumerate windows of the lengths of interest and cluster them. Lazily: the
        clusters are computed when first used, or written by ``save``. Buckets are 8, or
        as many as keep the most common length's groups to about PLANNED_ROWS windows (with
        ``warm``, where a bucket's lengths are one group, the groups of all lengths)."""
        cluster.check_threshold(st)
        K.check_metric(dist_type)
        lo, hi = subseq.resolve_lengths(loi, self.max_len())
        if n_buckets is None:
            self.settings = {"loi": [lo, hi]}
            many = self.num_windows() if warm else self.series.agg(F.sum(F.greatest(F.col("n") - lo + 1, F.lit(0)))).first()[0] or 0  # windows of the shortest length
            n_buckets = max(8, -(-many // cluster.PLANNED_ROWS))
        self.settings = {"st": st, "dist_type": dist_type, "loi": [lo, hi], "scheme": scheme, "n_buckets": n_buckets, "order": order, "prefilter": prefilter, "warm": warm, "piecewise": None, "n_segment": 3}
        self.pieces = None
        self.clusters = None if group_only else cluster.build_clusters(self.windows(), st, dist_type, order, prefilter, warm=warm).persist()
        return self

    def _built(self, clusters: bool = False) -> dict:
        if not self.settings or (clusters and self.clusters is None):
            raise ValueError("build the engine first")
        return self.settings

    def windows(self, data: bool = True) -> DataFrame:
        s = self._built()
        n = self.num_series() if s["scheme"] in ("series", "chunk") else 0
        return subseq.enumerate_windows(self.series, *s["loi"], s["scheme"], s["n_buckets"], n, "norm" if data else None)

    def num_windows(self) -> int:
        lo, hi = self._built()["loi"]
        top = F.least(F.lit(hi), F.col("n"))
        count = F.when(F.col("n") >= lo, (top - lo + 1) * (F.col("n") + 1) - (top + lo) * (top - lo + 1) / 2).otherwise(0)
        return int(self.series.agg(F.sum(count)).first()[0] or 0)

    def windows_of_len(self, n: int) -> DataFrame:
        return self.windows().where(F.col("len") == n)

    def cluster_meta(self) -> DataFrame:
        self._built(True)
        return cluster.cluster_sizes(self.clusters)

    def num_clusters(self) -> int:
        self._built(True)
        return self.clusters.where("is_rep").count()

    def cluster_of(self, series_id: str, start: int, end: int) -> DataFrame:
        self._built(True)
        return cluster.members_of(self.clusters, series_id, start, end)

    # -- querying ----------------------------------------------------------------
    def resolve(self, q) -> query.Query:
        """A query from (series_id, start, end), or from any iterable of numbers."""
        if isinstance(q, query.Query):
            return q
        if isinstance(q, str):
            raise ValueError("a query is a window or a sequence of numbers, not text")
        if isinstance(q, tuple) and len(q) == 3 and isinstance(q[0], str):
            return query.Query(tuple(self.window_data(*q)), q[0])
        if not isinstance(q, Iterable):
            raise TypeError("a query must be iterable")
        values = list(q)
        if any(isinstance(v, Iterable) for v in values):
            raise ValueError("queries have one dimension")
        if not values:
            raise ValueError("the query is empty")
        return query.Query(tuple(float(v) for v in values))

    def query(self, q, best_k: int, id_filter=None, filter_mode=None, loi=None, exclude_same_id: bool = False, overlap: float = 1.0, lb_opt=False, ke: int | None = None, radius: int = 1, ke_factor: int = 1, filter_stage: str = "post") -> DataFrame:
        """Approximate k best matches through the clusters."""
        s = self._built(True)
        ke = ke or best_k * ke_factor
        query.check_query(best_k, id_filter, filter_mode, overlap, self.num_windows(), ke)
        lengths = subseq.resolve_query_lengths(loi, tuple(s["loi"]))
        return query.index_query(self.clusters, self._with_data, self.resolve(q), best_k, s["dist_type"], lengths, ke, radius, exclude_same_id, id_filter, filter_mode, overlap, filter_stage, lb_opt, s["st"])

    def query_nearest(self, q, best_k: int, loi=None) -> DataFrame:
        """k best members of the cluster of the nearest representative alone."""
        s = self._built(True)
        return query.nearest_cluster(self.clusters, self._with_data, self.resolve(q), best_k, s["dist_type"], subseq.resolve_query_lengths(loi, tuple(s["loi"])))

    def _with_data(self, pointers: DataFrame) -> DataFrame:
        return subseq.with_data(pointers, self.series)

    def query_brute_force(self, q, best_k: int, piecewise: str | None = None, use_built_piecewise: bool = True, **options) -> DataFrame:
        """Exact k best, or chosen by PAA or SAX and ranked by true distance. Options:
        exclude_same_id, id_filter, filter_mode, overlap; mode='fast' for approximate
        warping; prune, of exact scans only."""
        s = self._built()
        if piecewise is None and options.get("mode", "exact") == "exact":
            options.pop("mode", None)
            return query.scan(self.series, self.resolve(q), best_k, s["dist_type"], tuple(s["loi"]), **options)
        if options.pop("prune", False):
            raise ValueError("prune is for exact scans")
        if piecewise is None:
            return query.brute_force(self.windows(), self.resolve(q), best_k, s["dist_type"], **options)
        if use_built_piecewise:
            if self.pieces is None or s["piecewise"] != piecewise:
                raise ValueError(f"build_piecewise({piecewise!r}) first")
            return query.piecewise(self.pieces, self.resolve(q), best_k, s["dist_type"], piecewise, s["n_segment"], "piece", **options)
        return query.piecewise(self.windows(), self.resolve(q), best_k, s["dist_type"], piecewise, s["n_segment"], **options)

    def query_batch(self, queries: DataFrame, best_k: int, exclude_same_id: bool = False) -> DataFrame:
        """Exact k best of a table of queries (query_id, qdata, qseries)."""
        return query.batch(self.windows(), queries, best_k, self._built()["dist_type"], exclude_same_id)

    def queries_at(self, pointers: DataFrame) -> DataFrame:
        """Pointers (query_id, series_id, start, end), as ``read_queries`` gives them, as a
        table for ``query_batch``; those outside their series are left out."""
        inside = subseq.exists(pointers.withColumn("len", F.col("end") - F.col("start") + 1), self.series)
        return self._with_data(inside).select("query_id", F.col("data").alias("qdata"), F.col("series_id").alias("qseries"))

    def queries_of(self, raw: DataFrame) -> DataFrame:
        """Value queries (query_id, data) on the data's own scale, as a table for ``query_batch``."""
        return raw.select("query_id", K.minmax(F.col("data"), *self.scale).alias("qdata"), F.lit(None).cast("string").alias("qseries"))

    # -- derived -----------------------------------------------------------------
    def build_piecewise(self, mode: str, n_segment: int = 3) -> Engine:
        s = self._built()
        if mode not in ("paa", "sax"):
            raise ValueError("piecewise mode must be 'paa' or 'sax'")
        self.set_piecewise_segment(n_segment)
        form = K.paa if mode == "paa" else K.sax
        s["piecewise"] = mode
        self.pieces = self.windows().withColumn("piece", form(F.col("data"), n_segment).cast("array<double>")).persist()
        return self

    def set_piecewise_segment(self, n: int) -> None:
        self._built()["n_segment"] = n

    def motif_all_length(self, absolute: bool = True) -> DataFrame:
        self._built(True)
        return cluster.representativeness(self.clusters, absolute)

    def motif(self, k: int, overlap: float = 1.0, absolute: bool = True) -> DataFrame:
        self._built(True)
        return query.motifs(cluster.representativeness(self.clusters, absolute, False), k, overlap)

    def predict_label_knn(self, q, k: int, label_index: int) -> str | None:
        """The commonest label (a user-visible id feature) of the k best matches in other series; None on a tie."""
        features = self.series.select(F.size("features")).first()
        place = label_index + (1 if self.has_uuid else 0)
        if features is None or not 0 <= label_index or place >= features[0]:
            raise ValueError("label index is out of bounds")
        row = query.vote(self.query(q, k, exclude_same_id=True), self.series, place).first()
        return row.label if row else None

    # -- storage -----------------------------------------------------------------
    def save(self, path: str) -> None:
        tables = {"series": self.series} | ({"clusters": self.clusters} if self.clusters is not None else {}) | ({"pieces": self.pieces} if self.pieces is not None else {})
        store.save(self.spark, path, {"scale": list(self.scale), "has_uuid": self.has_uuid, "build": self.settings, "tables": sorted(tables)}, tables)

    def stop(self) -> None:
        """Release cached tables; the session belongs to the caller."""
        for t in (self.base, self.clusters, self.pieces):
            if t is not None:
                t.unpersist()


def from_db(spark: SparkSession, path: str) -> Engine:
    """An engine saved by ``Engine.save``."""
    settings, tables = store.load(spark, path)
    out = Engine(spark, tables["series"], settings["has_uuid"], tuple(settings["scale"]))
    out.settings, out.clusters, out.pieces = settings["build"], tables.get("clusters"), tables.get("pieces")
    return out


def from_table(spark: SparkSession, source, feature_num: int, header: bool = True, rows=None, z_normalise: bool = False) -> Engine:
    """An engine over a CSV, TSV or Parquet file, a DataFrame, a pandas frame or a numpy block."""
    s, has_uuid = sources.to_series(sources.read_table(spark, source, header), feature_num, rows, z_normalise)
    return Engine(spark, s, has_uuid)


def load(spark: SparkSession, path: str, feature_num: int | None = None, header: bool = True, rows=None) -> Engine:
    """A data file (needs ``feature_num``) or a folder written by ``save``."""
    if not isinstance(path, str):
        raise TypeError("path must be text")
    if not store.path_exists(spark, path):
        raise ValueError(f"no such file or database: {path}")
    if store.path_exists(spark, f"{path}/settings"):
        return from_db(spark, path)
    if isinstance(feature_num, bool) or not isinstance(feature_num, int):
        raise TypeError("please provide an integer feature number")
    return from_table(spark, path, feature_num, header, rows)


def motif_across(spark: SparkSession, series: DataFrame, feature: int, st: float, k: int, loi, dist_type: str = "eu", overlap: float = 1.0) -> DataFrame:
    """Motifs of every value of an id feature: value, rank, len, series_id, start, end, score.

    Each value, null too, has its own scale and its own clusters. One plan for all values:
    the value is a key of scaling, clustering and ranking."""
    of = F.element_at("features", feature + 1)
    keyed = series.drop("norm").withColumn("value", of)
    lo, hi = subseq.resolve_lengths(loi, keyed.agg(F.max("n")).first()[0] or 0)
    many = keyed.agg(F.sum(F.greatest(F.col("n") - lo + 1, F.lit(0)))).first()[0] or 0
    scales = keyed.groupBy(F.col("value").alias("_of")).agg(F.min(F.array_min("values")).alias("_lo"), F.max(F.array_max("values")).alias("_hi"))
    scaled = keyed.join(scales, F.col("value").eqNullSafe(F.col("_of"))).withColumn("norm", F.transform("values", lambda v: F.when(F.col("_hi") > F.col("_lo"), (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)))
    windows = subseq.enumerate_windows(scaled, lo, hi, "dss", max(8, -(-many // cluster.PLANNED_ROWS)))
    clusters = cluster.build_clusters(windows, cluster.check_threshold(st), dist_type, by=[of]).withColumn("value", of)
    scores = clusters.groupBy("value", *cluster.REP).agg(F.count("*").cast("double").alias("score"))
    return query.motifs(scores, k, overlap, "value")


def session_settings(spark: SparkSession) -> dict[str, str | int | None]:
    """Parallelism and memory of the session an engine runs in."""
    named = ("spark.driver.memory", "spark.driver.maxResultSize", "spark.executor.memory", "spark.sql.shuffle.partitions", "spark.checkpoint.dir")
    conf = spark.sparkContext.getConf()
    return {"parallelism": spark.sparkContext.defaultParallelism} | {k: spark.conf.get(k, None) or conf.get(k) for k in named}


def prepare_folder(spark: SparkSession, files: list[str], feature_num: int, out: str, rate: float, seconds: tuple[float, float], st: float = 0.1, header: bool = False) -> list[str]:
    """Load, build with lengths from durations times a sampling rate, and save each file."""
    saved = []
    for f in files:
        e = from_table(spark, f, feature_num, header).build(st, loi=[max(1, int(s * rate)) for s in seconds])
        saved.append(f"{out}/{f.rsplit('/', 1)[-1]}")
        e.save(saved[-1])
    return saved
