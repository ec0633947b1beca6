"""From raw documents to token digests: toxicity, language, near duplicates, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, further
ones and those whose names the operators use among them, with their values. Repeated rows are documents of their own up to
the near duplicates. An empty table gives no rows in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemara.llm import bpe, language, mixing, similar, toxicity
from telemara.llm.common import documents, fresh_path, others, renamed
from telemara.llm.queries import BPE_RANKS

#: A text whose best language is no likelier than this is in none that the model knows.
MIN_LANGUAGE_SCORE = 0.4


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity score from the operator's threshold on; texts that are null or without a word stay."""
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, name = renamed(docs)
    return toxicity.score(plain, net, text=name["text"]).where("predicted = 0").select(others(name))


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, null texts among them, and those that resemble no language learnt."""
    plain, name = renamed(docs)
    marked = language.identify(plain, language.fit(docs), text=name["text"])
    return marked.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(others(name))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates, shingle sets of Jaccard similarity 0.8 or more, the document with the smallest id.

    Null texts and texts without a word are equal to one another; of equal ids in a group one row stays.
    """
    return similar.drop_similar(docs, width=5, radius=4)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of its source has it: not at all up to three times."""
    return mixing.take_mix(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes each text of the mix."""
    return bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


STAGES = [("toxicity", without_toxic), ("language", in_a_language), ("near_duplicates", one_of_near_duplicates), ("mixing", mixed), ("bpe", tokenised)]

#: Trained scores, fingerprints by XXH64 and tokenizers are beyond SQL; tests/llm holds the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
