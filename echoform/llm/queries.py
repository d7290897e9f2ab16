"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoform.llm import bpe, cotraining, fingerprints, nn_descent, packing, parity_join, sharding, toxicity, url_reputation, warc

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_fingerprints(table(spark, sf_dir, "documents"))


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score_documents(*(table(spark, sf_dir, t) for t in ("documents", "pages", "labels")))


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_reputation.filter_urls(table(spark, sf_dir, "pages"), outcomes)


#: Texts under so many characters are context only: their tokens bear no loss.
CONTEXT_CHARS = 40
#: All three bind: whole documents that bear loss leave a little room for context, and short ones run out of segments.
PACK_LIMITS = packing.Limits(tokens=4096, segments=48, loss=4064)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.length(F.trim("text")) >= CONTEXT_CHARS).alias("bears"))
    return packing.pack_documents(docs, WORD_BPE, PACK_LIMITS, "bears")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_nn_descent, op2_fingerprints, op3_cotraining, op4_parity_join, op5_warc, op6_url_reputation, op7_packing, op8_bpe, op9_sharding, op10_toxicity)}


#: Reachability over links (u, v) both ways, and the smallest id reached.
_REACH = """reach as (select id, id c from ids union select l.v, r.c from reach r join both_ways l on l.u = r.id),
comp as (select id, min(c) component_id from reach group by id)"""

NEAR_VECTORS = f"""with recursive x as (select vec_id, label, embedding::double[] e from embeddings),
ok as (select vec_id, label, e, sqrt(list_dot_product(e, e)) n from x where label is not null and e is not null and len(list_filter(e, lambda v: v is null or not isfinite(v))) = 0 and list_dot_product(e, e) > 0),
links as (select a.vec_id u, b.vec_id v from ok a join ok b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id < b.vec_id where list_dot_product(a.e, b.e) / (a.n * b.n) >= {nn_descent.THRESHOLD}),
both_ways as (select u, v from links union all select v, u from links), ids as (select vec_id id from embeddings), {_REACH},
deg as (select u id, count(*) n from both_ways group by u)
select comp.id vec_id, coalesce(deg.n, 0)::bigint n_links, component_id, component_id = comp.id kept, 1.0::double audited_recall from comp left join deg using (id)"""

NEAR_TEXTS = f"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda z: z <> '') w from documents),
s as (select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from w),
n as (select doc_id, count(*) n from s group by 1),
c as (select a.doc_id u, b.doc_id v, count(*) i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select u, v from c join n a on a.doc_id = u join n b on b.doc_id = v where 100 * i >= 75 * (a.n + b.n - i)),
both_ways as (select u, v from links union all select v, u from links), ids as (select doc_id id from documents), {_REACH}
select id doc_id, coalesce(n.n, 0)::bigint n_shingles, component_id, component_id = id kept from comp left join n on n.doc_id = id"""

ARCHIVES = """with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) k from pages),
f as (select *, min(page_id) over (partition by k) first from p)
select page_id, strlen(h)::bigint payload_bytes,
  array_to_string(list_transform(range(0, 4), lambda i: translate(to_base(('0x' || substr(k, (i * 10 + 1)::bigint, 10))::bigint, 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to
from f"""


def oracle_sql() -> dict[str, str]:
    return {"op1_nn_descent": NEAR_VECTORS, "op4_parity_join": NEAR_TEXTS, "op5_warc": ARCHIVES, "op6_url_reputation": url_reputation.oracle()}
