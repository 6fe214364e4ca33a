"""A corpus from raw documents to packed sequences, in five stages.

Every stage takes what the one before it kept, written as Parquet and read again. All but the last return the columns of
`documents`:

* quality classifier: documents that are predicted bad go;
* n-gram Jaccard join: of each group of near duplicates the document with the least id stays;
* secret scans: found secrets, plain or encoded, are replaced in the text, and n_chars follows;
* mixing: each document comes as often as the mix of sources takes it;
* packing: sequences of tokens along a space-filling curve, one row per piece.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneldrift.llm import jaccard, mixing, packing, quality, secrets
from paneldrift.session import shared_folder

#: Shingles of five words, similarity 0.8: the stage's own rule, not that of op4.
NEAR = jaccard.Rule(5, 80, 100)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, NEAR)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), spaced=True, end_id=0)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("mix sources", mix_sources),
    ("pack sequences", pack_sequences),
]

#: Trained weights, decoded layers and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
