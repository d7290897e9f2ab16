"""Saving and loading an engine: Parquet tables and one JSON line of settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def path_exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def save(spark: SparkSession, path: str, settings: dict, tables: dict[str, DataFrame]) -> None:
    """Overwrite a folder with the given tables; those that have lengths are partitioned by them."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("len") if "len" in df.columns else writer).parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    if not path_exists(spark, path):
        raise ValueError(f"no such database: {path}")
    if not path_exists(spark, f"{path}/settings"):
        raise ValueError(f"not a database: {path}")
    settings = json.loads(spark.read.text(f"{path}/settings").first().value)
    return settings, {t: spark.read.parquet(f"{path}/{t}") for t in settings["tables"]}


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).csv(path)
