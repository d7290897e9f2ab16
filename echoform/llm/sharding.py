"""Sharding by a hypergeometric communication matrix. DataFrame functions only.

A uniform shuffle with exact shard sizes: rows lie in source buckets; how many rows
each bucket sends to each shard is drawn from the multivariate hypergeometric law
(row sums: bucket counts, column sums: shard sizes); every bucket is permuted
locally and dealt out by those counts; every shard is permuted again. Only counts
travel to the driver: one number per bucket, at most ``MAX_SOURCES``.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoform.llm.common import Scratch

MIN_SOURCES, MAX_SOURCES, ROWS_PER_SOURCE = 64, 4096, 250_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """One hypergeometric draw by inversion outwards from the mode; any size of population."""
    total, lo, hi = good + bad, max(0, draws - bad), min(draws, good)
    if lo >= hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (total + 2)))
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    top = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(total, draws))
    u = rng.random() - top
    left = right = mode
    p_left = p_right = top
    while u > 0 and (left > lo or right < hi):
        if right < hi:
            p_right *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > lo:
            p_left *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Exact counts[i] -> sizes[j] flows of a uniform permutation of sum(counts) rows."""
    rng, left, rest = random.Random(seed), list(sizes), sum(sizes)
    out = []
    for c in counts:
        row, todo, pool = [], c, rest
        for s in left:
            x = hypergeometric(rng, s, pool - s, todo)
            row.append(x)
            todo -= x
            pool -= s
        left = [s - x for s, x in zip(left, row, strict=True)]
        rest -= c
        out.append(row)
    return out


def shard_rows(rows: DataFrame, keys: list[str], shards: int = 24, seed: int = 20, sources: int | None = None) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard) to slim rows.

    ``keys`` name the columns a row is told by; rows equal in all of them are
    interchangeable. Null keys are dealt like any other. Shard sizes differ by one
    at most; an empty table stays empty. Extra columns ride along; columns named shard
    or slot are replaced, and names that begin with two underscores are reserved."""
    spark, rows = rows.sparkSession, rows.drop("shard", "slot")
    scratch = Scratch(spark, "shards")
    base = scratch.write(rows)
    n = base.count()
    b = sources or min(MAX_SOURCES, max(MIN_SOURCES, -(-n // ROWS_PER_SOURCE)))
    told = [F.col(k) for k in keys]
    source = F.pmod(F.xxhash64(F.lit(seed), *told), F.lit(b)).cast("int")
    base = base.withColumn("__src", source)
    have = {r["__src"]: r["count"] for r in base.groupBy("__src").count().collect()}  # at most b rows
    counts = [have.get(i, 0) for i in range(b)]
    sizes = [n // shards + (j < n % shards) for j in range(shards)]
    ends = []
    for i, row in enumerate(communication_matrix(counts, sizes, seed)):
        total, e = 0, []
        for x in row:
            total += x
            e.append(total)
        ends.append({"__src": i, "__ends": e})
    matrix = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(ends)), "array<struct<__src:int,__ends:array<bigint>>>")).alias("m")).select("m.*")
    first = Window.partitionBy("__src").orderBy(F.xxhash64(F.lit(seed + 1), *told), *told)
    dealt = (
        base.withColumn("__rank", F.row_number().over(first)).join(F.broadcast(matrix), "__src")  # at most MAX_SOURCES rows
        .withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__rank"))))
        .drop("__ends", "__rank", "__src")
    )
    # Permute again: a row's place is the order of a second hash, cut into ranges so that no shard is one task.
    bits = max(4, math.ceil(math.log2(b)) - 4)
    dealt = scratch.write(dealt.withColumn("__key", F.xxhash64(F.lit(seed + 2), *told)).withColumn("__sub", F.shiftrightunsigned("__key", 64 - bits).cast("int")))
    sub = dealt.groupBy("shard", "__sub").count()  # shards * 2**bits rows
    before = sub.withColumn("__from", F.sum("count").over(Window.partitionBy("shard").orderBy("__sub")) - F.col("count")).drop("count")
    second = Window.partitionBy("shard", "__sub").orderBy("__key", *told)
    return dealt.withColumn("__rank", F.row_number().over(second)).join(F.broadcast(before), ["shard", "__sub"]).withColumn("slot", F.col("__from") + F.col("__rank") - 1).drop("__from", "__rank", "__sub", "__key")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """Shard documents under the law ``rows``: (doc_id, size, text_crc32, law, shard,
    slot, grown_shard). Size is the text's UTF-8 bytes plus 8 (null: 8). Equal texts
    need not share a shard. Texts stay where they are; only slim rows move."""
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    slim = docs.select("doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    out = shard_rows(slim, ["doc_id", "text_crc32", "size"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
