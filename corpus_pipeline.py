"""Corpus pipeline: from raw documents to packed training sequences.

STAGES, in order: toxicity (rejected documents go), quality (rejected documents go), SimHash near-duplicates (one
document of each group stays), secret scans (secrets are replaced in the texts), best-fit packing (one row per
piece with its place in a sequence). Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
reread as the next one's docs. All but the last return the columns of documents.

Defined results: a NULL text counts as empty where it is scored, and stays NULL; documents with equal texts are one
near-duplicate group, of which the one with the smallest doc_id (then the first in the table) stays, a NULL doc_id
last; extra columns are carried along; empty tables give empty results.

``run`` writes the stages into a new folder of the shared one that ``spark.checkpoint.dir`` names. SQL can't express
the stages (trained models, fingerprint components, a genetic algorithm), so ORACLE_SQL is None; the tests hold each
stage against a brute-force version.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import packing, quality, secret_scan, simhash_vptree, toxicity
from ledgerline.session import ensure_checkpoint_dir

ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, _labels(spark, sf_dir), threshold=0.7)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs, _labels(spark, sf_dir), threshold=0.3)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_vptree.keep_one_of_each_group(docs, id_col="doc_id", shingle=3, radius=3)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.remove_secrets(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


STAGES = [
    ("toxicity", stage_toxicity),
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("secrets", stage_secrets),
    ("packing", stage_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a written table."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
