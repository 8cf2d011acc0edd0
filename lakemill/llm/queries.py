"""The queries opN_<name> over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakemill.llm.chat import ORACLE as CHAT_SQL
from lakemill.llm.chat import link_tool_calls
from lakemill.llm.embedding_dedup import embedding_components
from lakemill.llm.huffman import round_trip
from lakemill.llm.mixing import mix
from lakemill.llm.packing import pack
from lakemill.llm.pii import find_pii
from lakemill.llm.simhash import simhash_components
from lakemill.llm.token_counts import count_tokens
from lakemill.llm.topk import top_k
from lakemill.llm.toxicity import score


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(_read(spark, sf_dir, "conversations"))


def op4_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_read(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_read(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_read(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_read(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_chat": op3_chat,
    "op4_huffman": op4_huffman,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_packing": op6_packing,
    "op7_token_counts": op7_token_counts,
    "op8_pii": op8_pii,
    "op9_top_k": op9_top_k,
    "op10_toxicity": op10_toxicity,
}

#: Brute force in SQL: exact top-k by all products, links of all pairs with the components by recursion.
ORACLES: dict[str, str] = {
    "op3_chat": CHAT_SQL,
    "op9_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::double) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from p)
select query_id, rank, vec_id, score from r where rank <= 20
""",
    "op5_embedding_dedup": """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join l on r.b = l.a),
c as (select a, min(b) as component_id from reach group by a)
select v.vec_id, (select count(*) from l where l.a = v.vec_id)::bigint as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join c on c.a = v.vec_id
""",
}
