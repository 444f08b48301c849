"""The corpus pipeline: language identification, near-duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import decontam, langid, minhash, mixing, sharding
from pathloom.llm.common import release, scope, shared_dir, written

#: Documents whose language is less certain go.
LANGUAGE_SCORE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language the model is sure of; it learns from the documents it is given."""
    model = langid.fit(langid.training_rows(docs))
    at = [f"c{i}_" for i in range(len(docs.columns))]
    known = langid.identify(docs.toDF(*at), model, at[docs.columns.index("text")])
    return known.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SCORE)).select(*[F.col(a).alias(c) for a, c in zip(at, docs.columns, strict=True)])


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.external_shuffle(docs)


STAGES = [
    ("language_id", identified),
    ("minhash_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("mixing", weighted),
    ("sharding", sharded),
]

#: The fitted language model has no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and what led to it is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scope(docs) as keep:
            out = stage(spark, docs, sf_dir)
            last = name == STAGES[-1][0]
            done = written(out, f"pipeline-{name}") if not last else shards(out)
            keep.append(done)
        release(docs)
        docs = done
    return docs


def shards(out: DataFrame) -> DataFrame:
    """The last stage's result as a folder per shard, read again."""
    spark = out.sparkSession
    path = f"{shared_dir(spark)}/pipeline-shards-{uuid.uuid4().hex}"
    sharding.write_shards(out, path)
    return spark.read.schema(out.schema).parquet(path).select(*[F.col(f"`{c}`") for c in out.columns])
