"""Registered queries of the tokenizing and classifying operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_reuse import encode_decode
from .language_id import language_id
from .packing import pack_documents
from .toxicity import toxicity


def packed(docs: DataFrame) -> DataFrame:
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "tier",
        "step_group",
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return toxicity(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/labels.parquet"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_bpe_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op7_bpe_reuse": op7_bpe_reuse, "op8_packing": op8_packing, "op9_toxicity": op9_toxicity, "op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
