"""Readers: wide CSV, TSV, Parquet, pandas or numpy tables, event logs -> series.

A series row: series_id STRING, ts_idx LONG (its place in the input), features
ARRAY<STRING>, values ARRAY<DOUBLE> (missing samples left out), n INT.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _numbered(df: DataFrame) -> DataFrame:
    """Add ts_idx, the 0-based place of each row, from partition sizes: one number a partition reaches the driver."""
    df = df.withColumn("_mid", F.monotonically_increasing_id())
    part, within = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND((1 << 33) - 1)
    total, start = 0, {}
    for r in sorted(df.groupBy(part.alias("p")).count().collect(), key=lambda r: r.p):
        start[r.p], total = total, total + r["count"]
    if not start:
        return df.withColumn("ts_idx", F.col("_mid")).drop("_mid")
    offsets = F.create_map(*[F.lit(x) for p, o in start.items() for x in (int(p), int(o))])
    return df.withColumn("ts_idx", F.element_at(offsets, part) + within).drop("_mid")


def series_id(parts: list[Column]) -> Column:
    """One text of several: joined by ``|``, which is escaped inside a part, as is the
    escape; a null part is told from all texts."""
    safe = [F.coalesce(F.regexp_replace(p.cast("string"), r"([|\\])", r"\\$1"), F.lit("\\0")) for p in parts]
    return F.concat_ws("|", *safe)


def need_uuid(df: DataFrame, columns: list[str]) -> bool:
    """Whether rows need a generated id: no id columns, or ids that repeat."""
    return not columns or bool(df.groupBy(*columns).count().where("count > 1").limit(1).count())


def generated_id(ts_idx: Column) -> Column:
    """A UUID-shaped id (version 4 layout) that follows from the row's place alone."""
    h = F.md5(F.concat(F.lit("series-"), ts_idx.cast("string")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def to_series(df: DataFrame, feature_num: int, rows=None, z_normalise: bool = False) -> tuple[DataFrame, bool]:
    """A wide table (first ``feature_num`` columns identify, the rest are samples) -> (series, has_uuid).

    ``rows``: None or inf for all, an int for the first so many, (a, b) for a <= place < b."""
    if isinstance(feature_num, bool) or not isinstance(feature_num, int):
        raise TypeError("please provide an integer feature number")
    if feature_num < 0 or feature_num > len(df.columns):
        raise ValueError("incorrect feature_num")
    ids, samples = df.columns[:feature_num], df.columns[feature_num:]
    df = _numbered(df)
    has_uuid = need_uuid(df, ids)
    if rows is not None and rows != float("inf"):
        lo, hi = (0, rows) if isinstance(rows, int) else tuple(rows) if isinstance(rows, (list, tuple)) and len(rows) == 2 else (None, None)
        if lo is None:
            raise ValueError("rows must be an int or a pair [a, b)")
        df = df.where((F.col("ts_idx") >= lo) & (F.col("ts_idx") < hi))
    kinds = dict(df.dtypes)
    raw = F.array(*[F.col(f"`{c}`").cast("string") for c in samples]) if samples else F.array().cast("array<string>")
    if any(kinds[c] == "string" for c in samples):
        filled = F.filter(raw, lambda v: v.isNotNull() & (F.trim(v) != "") & (F.lower(F.trim(v)) != "nan"))
        if df.where(F.exists(filled, lambda v: v.try_cast("double").isNull())).limit(1).count():
            raise ValueError("incorrect feature_num: a sample column is not numeric")
        values = F.transform(filled, lambda v: v.cast("double"))
    else:
        values = F.array(*[F.col(f"`{c}`").cast("double") for c in samples]) if samples else F.array().cast("array<double>")
    values = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    features = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ids]
    n_features = len(ids) + has_uuid
    key = series_id([F.element_at("features", i + 1) for i in range(n_features)])
    out = df.select(F.array(*([generated_id(F.col("ts_idx"))] if has_uuid else []), *features).alias("features"), "ts_idx", values.alias("values"))
    if z_normalise:
        from echoform.functions.kernels import znorm

        out = out.withColumn("values", znorm(F.col("values")))
    return out.select(key.alias("series_id"), "ts_idx", "features", "values", F.size("values").alias("n")), has_uuid


def read_table(spark: SparkSession, source, header: bool = True) -> DataFrame:
    """CSV (``.csv`` or no extension), TSV, Parquet, a pandas frame or a numpy block as a DataFrame."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, np.ndarray):
        source = pd.DataFrame(source)
    if isinstance(source, pd.DataFrame):
        return spark.createDataFrame(source.rename(columns=str))
    if not isinstance(source, str):
        raise TypeError("source must be a path, a DataFrame, a pandas frame or a numpy array")
    tail = source.rsplit("/", 1)[-1]
    ext = tail.rsplit(".", 1)[-1].lower() if "." in tail else "csv"
    if ext == "parquet":
        return spark.read.parquet(source)
    if ext not in ("csv", "tsv"):
        raise ValueError(f"unsupported file type {ext!r}")
    return spark.read.option("header", header).option("sep", "\t" if ext == "tsv" else ",").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(source)


def from_events(events: DataFrame, key: list[str], order: list[str], sample: str) -> DataFrame:
    """A long table -> series: one per key, samples in the given order. ts_idx is the first
    key where that is a whole number, else a hash of all (``ordinal`` gives places)."""
    rows = events.where(F.col(sample).isNotNull()).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(sample).cast("double").alias("_v")))).alias("s"))
    features = F.array(*[F.col(k).cast("string") for k in key])
    name = series_id([F.col(k) for k in key])
    whole = events.select(key[0]).dtypes[0][1] in ("tinyint", "smallint", "int", "bigint")
    place = F.col(key[0]).cast("long") if whole else F.shiftrightunsigned(F.xxhash64(name), 1)
    out = rows.select(name.alias("series_id"), place.alias("ts_idx"), features.alias("features"), F.transform("s", lambda s: s["_v"]).alias("values"))
    return out.withColumn("n", F.size("values"))


def from_arrays(df: DataFrame, features: list[str], values: str, index: str) -> DataFrame:
    """A table with one array a row -> series."""
    f = F.array(*[F.col(c).cast("string") for c in features])
    v = F.filter(F.col(values).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x))
    return df.select(series_id([F.col(c) for c in features]).alias("series_id"), F.col(index).cast("long").alias("ts_idx"), f.alias("features"), v.alias("values"), F.size(v).alias("n"))


def read_trimmed(spark: SparkSession, path: str, feature_num: int) -> DataFrame:
    """A CSV padded with zeros or blanks at row ends -> series without that padding."""
    df = _numbered(read_table(spark, path, True))
    ids, samples = df.columns[:feature_num], [c for c in df.columns[feature_num:] if c != "ts_idx"]
    raw = F.array(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in samples])
    last = F.array_max(F.transform(raw, lambda v, i: F.when(~v.isin("0", "", ","), i + 1).otherwise(0)))
    values = F.transform(F.filter(F.slice(raw, 1, last), lambda v: v != ""), lambda v: v.cast("double"))
    f = F.array(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in ids])
    return df.select(series_id([F.element_at(f, i + 1) for i in range(len(ids))]).alias("series_id"), "ts_idx", f.alias("features"), values.alias("values"), F.size(values).alias("n"))


def read_queries(spark: SparkSession, path: str, feature_num: int, header: bool = True) -> DataFrame:
    """Pointer queries: id columns, start, end (inclusive) -> (query_id, series_id, start, end)."""
    df = _numbered(read_table(spark, path, header))
    ids, (s, e) = df.columns[:feature_num], df.columns[feature_num : feature_num + 2]
    return df.select(F.col("ts_idx").alias("query_id"), series_id([F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in ids]).alias("series_id"), F.col(f"`{s}`").cast("int").alias("start"), F.col(f"`{e}`").cast("int").alias("end"))


def read_raw_queries(spark: SparkSession, path: str, skip: int = 0, header: bool = False) -> DataFrame:
    """Value queries, one a row, without the first ``skip`` columns -> (query_id, data)."""
    df = _numbered(read_table(spark, path, header))
    cols = [c for c in df.columns[skip:] if c != "ts_idx"]
    data = F.filter(F.array(*[F.col(f"`{c}`").try_cast("double") for c in cols]), lambda v: v.isNotNull() & ~F.isnan(v))
    return df.select(F.col("ts_idx").alias("query_id"), data.alias("data"))


def list_files(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Files under a root that match a glob, sorted, on any file system Spark reads."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")
    found = path.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def training_files(spark: SparkSession, root: str, least: int = 0, most: float = float("inf")) -> list[str]:
    """``<name>/<name>_TRAIN.tsv`` files whose number of cells is in [least, most], smallest first."""
    sized = []
    for f in list_files(spark, root, "*/*_TRAIN.tsv"):
        df = read_table(spark, f, False)
        cells = df.count() * len(df.columns)
        if least <= cells <= most:
            sized.append((cells, f))
    return [f for _, f in sorted(sized)]


def paired_files(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """Alternating dataset and query files of a folder, in name order."""
    names = list_files(spark, root, "*")
    return list(zip(names[::2], names[1::2], strict=False))


def ordinal(series: DataFrame) -> DataFrame:
    """Series with ts_idx replaced by their rank (for tables whose index has gaps); small tables only: ranks are over one ordering."""
    return series.withColumn("ts_idx", (F.row_number().over(Window.orderBy("ts_idx", "series_id")) - 1).cast("long"))
