"""Shared plumbing: scratch tables in the cluster's shared folder, components.

Scratch tables are Parquet written under ``spark.checkpoint.dir``: they cut
lineage, survive the loss of executors, and are visible to every machine.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN_DIRS: dict[str, str] = {}
#: Folders of every Scratch of an application, for ``discard``.
_ROOTS: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share; one of our own only where none is set and there is
    one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="echoform-")
        spark.sparkContext.setCheckpointDir(_OWN_DIRS[app])
    return _OWN_DIRS[app]


def widened(df: DataFrame, ddl: str) -> StructType:
    """df's schema followed by the columns of a DDL string."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of fewer rows than Spark's default of 10,000, which of long texts
    would fill an executor; a size the user chose stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def release() -> None:
    """Give free memory back to the system: Python workers live on for other operators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Scratch:
    """Writes intermediate tables to the shared folder and deletes those no longer read."""

    def __init__(self, spark: SparkSession, tag: str):
        bound_batches(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame) -> DataFrame:
        path = self.path(f"t{self.n}")
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t), (None, None))
            if path:
                _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(spark: SparkSession) -> None:
    """Delete every scratch folder of this application: once its results are consumed or
    written, for results read their last tables lazily."""
    for root in _ROOTS.pop(spark.sparkContext.applicationId, []):
        _delete(spark, root)


def forest(pairs: np.ndarray) -> np.ndarray:
    """(n, 2) integer edges -> (m, 2) rows (vertex, smallest vertex of its tree)."""
    if not len(pairs):
        return pairs.reshape(0, 2)
    names, flat = np.unique(pairs, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(names))
    return np.stack([names[keep], names[label[keep]]], axis=1)


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    have = np.empty((0, 2), np.int64)
    for b in batches:
        new = np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)], axis=1)
        have = forest(np.concatenate([have, new.astype(np.int64)]))
        while len(have) > 2_000_000:  # bounded: hand on what is contracted so far
            yield pa.RecordBatch.from_arrays([pa.array(have[:1_000_000, 0]), pa.array(have[:1_000_000, 1])], names=["u", "v"])
            have = have[1_000_000:]
    yield pa.RecordBatch.from_arrays([pa.array(have[:, 0]), pa.array(have[:, 1])], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (u, v), both long -> (id, component) for all
    vertices but each component's smallest; component is that smallest vertex.

    Edges are first contracted within each partition, then large-star and
    small-star rounds alternate until every vertex points at its minimum. Hub
    vertices are pre-aggregated; the star joins are plain sort-merge joins, so
    adaptive execution splits hubs.
    """
    e = scratch.write(edges.select("u", "v").where("u <> v").mapInArrow(_local_forest, "u long, v long").distinct())
    mark = lambda t: tuple(t.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
    old = mark(e)
    while old[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = scratch.write(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(low, "u")
        small = scratch.write(
            linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        new = mark(small)
        scratch.drop(large, e)
        e = small
        if new == old:
            break
        old = new
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
