"""Corpus pipeline: quality, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs. All but the last return the columns of documents, extra
ones included. Empty tables give empty results. Null texts are judged as empty ones. Rows
are told apart by doc_id and text; the quality stage judges by doc_id, so it keeps rows
whose doc_id is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoform.llm import cotraining, packing, parity_join, toxicity
from echoform.llm.common import Scratch
from echoform.llm.queries import CONTEXT_CHARS, PACK_LIMITS, WORD_BPE, table

#: Id lists up to so many rows (8 bytes each) are broadcast; longer ones are shuffled.
BROADCAST_IDS = 2_000_000
#: Words whose ids a packing worker remembers during a task: workers share their machine with what earlier stages left.
PACK_WORDS = 300_000
#: Bytes of texts such a worker encodes at once, for the same reason.
PACK_BLOCK = 4 << 20


def without(docs: DataFrame, key: Column, rejected: DataFrame, scratch: Scratch) -> DataFrame:
    """docs but for those whose key is in rejected (one column, key)."""
    rejected = scratch.write(rejected.where("key is not null").distinct())
    small = rejected.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(rejected) if small else rejected, key == rejected.key, "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the co-trained classifier keeps; a repeated id stays if any of its rows is
    kept, a null one always."""
    judged = cotraining.score_documents(docs, table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    rejected = judged.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("key"))
    return without(docs, docs.doc_id, rejected, Scratch(spark, "stage-quality"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity operator does not reject, judged row by row."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, names=("__score", "__predicted")).where("__predicted = 0").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingle similarity, the document with the smallest id (then
    the smallest hash of id and text); of rows equal in id and text, one. Texts without
    words link with nothing."""
    scratch, key = Scratch(spark, "stage-copies"), F.xxhash64(docs.doc_id, docs.text)
    known = scratch.write(docs.select(key.alias("key"), docs.doc_id.alias("doc_id")))
    groups = parity_join.jaccard_components(docs.select(key.alias("doc_id"), docs.text.alias("text"))).select(F.col("doc_id").alias("key"), "component_id")
    groups = scratch.write(groups.distinct().join(known.distinct(), "key"))
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = scratch.write(first)
    first = F.broadcast(first) if first.count() <= BROADCAST_IDS else first
    rejected = groups.join(first, "component_id").where(F.col("key") != F.col("first.key")).select("key")
    out = without(docs, key, rejected, scratch)
    if known.count() != groups.count():  # a key of its own for every distinct pair of id and text
        out = out.withColumn("__key", F.xxhash64("doc_id", "text")).dropDuplicates(["__key"]).drop("__key")
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences, under the limits of the query of that
    operator; null ids and empty texts are packed too."""
    bearing = docs.select("doc_id", "text", (F.length(F.trim("text")) >= CONTEXT_CHARS).alias("bears"))
    return packing.pack_documents(bearing, WORD_BPE, PACK_LIMITS, "bears", most_words=PACK_WORDS, lasting=False, block=PACK_BLOCK)


STAGES = [("quality classifier", quality), ("toxicity", toxic), ("n-gram Jaccard join", near_copies), ("packing", pack)]

#: SQL cannot express the classifiers; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, old = scratch.write(stage(spark, docs, sf_dir)), docs
        scratch.drop(old)
    return STAGES[-1][1](spark, docs, sf_dir)
