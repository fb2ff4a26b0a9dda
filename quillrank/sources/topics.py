"""Topic files of three formats; topic files are small, each topic becomes a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_topics(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``topics(qid, query[, max_id])`` of a ``web``, ``terabyte`` or ``microblog`` file."""
    readers = {"web": _web, "terabyte": _terabyte, "microblog": _microblog}
    if kind not in readers:
        raise ValueError(f"unknown topic format {kind!r}")
    return readers[kind](spark, path)


def _last_per_number(topics: DataFrame) -> DataFrame:
    return topics.groupBy("qid").agg(F.max_by("query", "_at").alias("query"))


def _web(spark: SparkSession, path: str) -> DataFrame:
    blocks = spark.read.option("lineSep", "</topic>").text(path)
    topics = blocks.select(
        F.regexp_extract("value", r'<topic[^>]*\bnumber\s*=\s*"([^"]*)"', 1).try_cast("int").cast("string").alias("qid"),
        F.trim(F.regexp_extract("value", r"(?m)^[ \t]*<query>(.*)</query>[ \t]*\r?$", 1)).alias("query"),
        F.monotonically_increasing_id().alias("_at"),
    )
    return _last_per_number(topics.where(F.col("qid").isNotNull()))


def _terabyte(spark: SparkSession, path: str) -> DataFrame:
    blocks = spark.read.option("lineSep", "</top>").text(path).where(F.contains("value", F.lit("<top>")))
    topics = blocks.select(
        F.regexp_extract("value", r"(?m)^[ \t]*<num>.*[ ](\S+)[ \t]*\r?$", 1).try_cast("int").cast("string").alias("qid"),
        F.trim(F.regexp_extract("value", r"(?m)^[ \t]*<title>([^\r\n]*)", 1)).alias("query"),
        F.monotonically_increasing_id().alias("_at"),
    )
    return _last_per_number(topics.where(F.col("qid").isNotNull()))


def _microblog(spark: SparkSession, path: str) -> DataFrame:
    blocks = spark.read.option("lineSep", "</top>").text(path).where(F.contains("value", F.lit("<top>")))

    def part(tag: str, inner: str) -> Column:
        return F.nullif(F.regexp_extract("value", rf"(?s)<{tag}>\s*{inner}\s*</{tag}>", 1), F.lit(""))

    number = F.nullif(F.regexp_extract("value", r"(?s)<num>\s*Number:\s*(\S+)\s*</num>", 1), F.lit(""))
    topics = blocks.select(
        F.regexp_replace(number, r"^MB0(\d\d)$", "MB$1").alias("qid"),
        F.coalesce(part("title", "(.*?)"), part("query", "(.*?)")).alias("query"),
        part("querytweettime", r"(\d+)").cast("bigint").alias("max_id"),
    )
    complete = F.col("qid").isNotNull() & F.col("query").isNotNull() & F.col("max_id").isNotNull()
    return topics.where(F.when(complete, True).otherwise(F.raise_error(F.lit("topic without number, title or time")).cast("boolean")))


def run_qid(qid: str | Column) -> Column:
    """Topic number as run and judgment files write it: ``MB001`` and ``MB1`` become ``1``."""
    return F.regexp_replace(qid, "^MB0*", "")
