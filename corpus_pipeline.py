"""A training-data pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept,
and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import concat_packing, parity_join, pii_bootstrap, quality_gam, runlength_dedup
from helixframe.llm.common import fresh, release_path, shared_root, table
from helixframe.llm.queries import PATTERN, RANKS, TOKENIZER


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return quality_gam.keep_good(docs, model)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies, and rows without doc_id.

    Of rows that repeat a doc_id the one with the smallest text stays (null first).
    """
    cols, key = [F.col(f"`{c}`") for c in docs.columns], fresh(docs.columns, "key")
    found = parity_join.jaccard_components(docs)
    ids = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("rows"))
    kept = docs.join(ids, docs["doc_id"].cast("long") == ids[key], "inner")
    alone = kept.where(ids["rows"] == 1).select(*cols)
    several = kept.where(ids["rows"] > 1).select(*cols)
    order = F.struct(F.col("text"), *[c.cast("string") for c in cols])
    one = several.groupBy("doc_id").agg(F.min_by(F.struct(*cols), order).alias(key)).select(f"{key}.*")
    return alone.union(one).union(docs.where(F.col("doc_id").isNull()).select(*cols))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 100 bytes or more that also start earlier."""
    return runlength_dedup.dedup_texts(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii_bootstrap.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token stream into sequences of 1024; one row per piece."""
    return concat_packing.pack(docs, RANKS, PATTERN, concat_packing.added_tokens(TOKENIZER))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near),
    ("suffix-array dedup", cut_repeats),
    ("PII", redact_pii),
    ("packing", pack),
]

#: Training a classifier, cutting byte spans and tokenising are not SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}")
        if k:  # the stage before it is not read any more
            release_path(spark, f"{base}/{k - 1}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
