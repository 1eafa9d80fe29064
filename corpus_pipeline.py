"""The corpus pipeline: documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and hands on
what it reads back, so that a lost executor costs no earlier stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger.llm import mixing, near_dedup, packing, pii, quality
from geoledger.llm.common import table, tune, written
from geoledger.llm.queries import DOMAINS, WEIGHTS


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled documents among `docs`."""
    tune(spark)
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; of rows repeated in full, with an id, one stays."""
    tune(spark)
    ids = near_dedup.link(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    ids = written(ids.filter("NOT kept OR n > 1"), "pipeline-ids")
    # texts of ids that stand once aren't compared: they pass the one join
    once = docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    return once.unionByName(docs.join(ids.filter("kept").select("doc_id"), "doc_id", "left_semi").select(docs.columns).distinct())


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets; other documents stay as they are."""
    tune(spark)
    return pii.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources are brought to their target weights; a document of several epochs is several rows."""
    tune(spark)
    return mixing.mix(docs, domain=mixing.domain_by(DOMAINS), weights=WEIGHTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences."""
    tune(spark)
    return packing.pack(docs)


STAGES = [("quality", classify), ("near_dedup", deduplicate), ("pii", mask), ("mixing", mix), ("packing", pack)]

#: The classifier, signatures and token ids aren't SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
