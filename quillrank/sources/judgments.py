"""Judgments, feature files, runs, id lists, stop lists and term vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _last_line(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key: that of the last line. A maximum per key, formed before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, "_at")]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_at").alias("_last"))
    return last.select(*keys, "_last.*")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())


def _words(column: str = "value") -> Column:
    return F.split(F.trim(column), r"\s+")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``qrels(qid, doc_id, grade)``; the last grade wins when a pair is repeated."""
    lines = _numbered_lines(spark, path).select(_words().alias("w"), "_at").where(F.size("w") >= 4)
    rows = lines.select(F.col("w")[0].alias("qid"), F.col("w")[2].alias("doc_id"), F.col("w")[3].try_cast("int").alias("grade"), "_at")
    return _last_line(rows, "qid", "doc_id")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """``run(qid, doc_id, score, rank, tag)`` of a run file."""
    w = spark.read.text(path).select(_words().alias("w")).where(F.size("w") >= 6)
    return w.select(
        F.col("w")[0].alias("qid"), F.col("w")[2].alias("doc_id"), F.col("w")[4].cast("double").alias("score"),
        F.col("w")[3].cast("int").alias("rank"), F.col("w")[5].alias("tag"),
    )


def read_ltr(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, doc_id, grade, features)`` of ``grade qid:x 1:v ... # docid`` lines; the last line of a pair wins."""
    lines = _numbered_lines(spark, path).select(F.split("value", "#", 2).alias("p"), "_at").where(F.size("p") == 2)
    parts = lines.select(_words(F.col("p")[0]).alias("w"), F.trim(F.col("p")[1]).alias("doc_id"), "_at")
    value = F.transform(F.slice("w", 3, F.size("w")), lambda x: F.split(x, ":")[1].cast("double"))
    rows = parts.select(
        F.regexp_replace(F.col("w")[1], "^qid:", "").alias("qid"), "doc_id",
        F.col("w")[0].try_cast("int").alias("grade"), value.alias("features"), "_at",
    )
    return _last_line(rows, "qid", "doc_id")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ``(id)``: the first tab column, or the whole line. Compressed files are read as they are."""
    first = F.trim(F.split("value", "\t")[0])
    return spark.read.text(path).select(first.try_cast("bigint").alias("id")).where("id IS NOT NULL").distinct()


def read_stoplist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ``(term)``, one per line."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where(F.col("term") != "").distinct()


def read_cohort(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ``(user_id)``, one per line."""
    return read_stoplist(spark, path).withColumnRenamed("term", "user_id")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``vectors(term, embedding)`` of ``term v1 v2 ...`` lines.

    A first line of two whole numbers, the size of the table, is skipped.
    """
    lines = spark.read.text(path).select(_words().alias("w"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_line"))
    header = (F.size("w") == 2) & F.col("w")[0].rlike("^[0-9]+$") & F.col("w")[1].rlike("^[0-9]+$") & (F.col("_at") == 0) & (F.col("_line").bitwiseAND(F.lit((1 << 33) - 1)) == 0)
    words = lines.where((F.size("w") > 1) & ~header)
    return words.select(
        F.col("w")[0].alias("term"),
        F.transform(F.slice("w", 2, F.size("w")), lambda x: x.cast("float")).alias("embedding"),
    )
