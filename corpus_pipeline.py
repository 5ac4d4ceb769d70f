"""A training corpus from ``documents``: language, copies, near copies, mix, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm import bpe, langid, mix, neardup
from jobweave.llm.exact import keep_one
from jobweave.llm.queries import new_index
from jobweave.operators.scratch import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; rows that agree in all evidence share the decision."""
    mark = F.xxhash64("doc_id", "text", "lang", "source")
    rows = langid.document_evidence(docs, mark.alias("mark"))
    told = langid.identify(rows, langid.fit(docs), Scratch(spark), keys=["mark"])
    good = told.filter("kept").select(F.col("mark").alias("m")).distinct()
    packed = docs.select(F.struct("*").alias("row"), mark.alias("mark"))
    return packed.join(good, F.col("mark") == F.col("m"), "left_semi").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the largest doc_id."""
    return keep_one(docs, new_index(spark, Scratch(spark)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id."""
    told = neardup.near_duplicates(docs, Scratch(spark))
    gone = told.filter("NOT kept").select(F.col("doc_id").alias("d")).distinct()
    packed = docs.select(F.struct("*").alias("row"))
    return packed.join(gone, F.col("row.doc_id") == F.col("d"), "left_anti").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; documents appear as often as they are taken."""
    return mix.mixed(docs, Scratch(spark))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids, decoded_same): the ids of every text, decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    ids = bpe.encode(packed, path, keys=("doc_id", "source", "_sha"))
    return bpe.decode(ids, path).select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.sha2("text", 256) == F.col("_sha")).alias("decoded_same"),
    )


STAGES = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("mix", mixture),
    ("tokens", tokens),
]
# a language model, hashes and a tokenizer are beyond SQL; tests use brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
