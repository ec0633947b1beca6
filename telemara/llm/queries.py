"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, ctw, embeddings, fingerprints, language, merkle, mixing, periodic, personal, sharding, simhash, token_orc, toxicity
from .common import documents, fresh_path

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), width=4, radius=4)


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_index(documents(spark, sf_dir), 16)


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_index(documents(spark, sf_dir))


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_orc.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path(WORD_TOKENIZER))
    return token_orc.token_index(spark, path)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(documents(spark, sf_dir))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_index(documents(spark, sf_dir))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_index(documents(spark, sf_dir))


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.span_index(documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_fingerprints, op2_ctw, op3_bpe, op4_simhash, op5_shards, op6_vectors, op7_mix, op8_token_orc, op9_toxicity, op10_language, op11_periodic, op12_merkle, op13_personal)}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_vectors": """
            with recursive v as (select vec_id, embedding::double[] as e from embeddings),
            links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.9),
            reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join links l on r.b = l.a),
            comp as (select a, min(b) as component_id from reach group by a),
            degree as (select a, count(*) as n from links group by a)
            select v.vec_id, coalesce(d.n, 0) as n_links, c.component_id, v.vec_id = c.component_id as kept
            from v join comp c on c.a = v.vec_id left join degree d on d.a = v.vec_id"""
    }
