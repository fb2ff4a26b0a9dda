"""A corpus pipeline over ``documents``: five stages, each written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.bpe import encode_digests
from quillrank.llm.exact_dedup import drop_exact_copies
from quillrank.llm.hyperminhash import drop_near_copies
from quillrank.llm.language_id import with_language
from quillrank.llm.mixing import take_mix
from quillrank.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, in whatever language; ``lang`` is the language found from here on."""
    return with_language(docs, unknown=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a mix of the sources takes, a row for each time; n_chars follows the text."""
    return take_mix(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids, and of the bytes they decode to, with language and source of each row."""
    return encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, carry=("lang", "source"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("byte_level_bpe", encode),
]

#: SQL can't express language models, seeded selection or a tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
