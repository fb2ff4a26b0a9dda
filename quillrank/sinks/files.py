"""Text and table sinks. Every task writes its own file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_lines(run: DataFrame, tag: str) -> DataFrame:
    """``qid Q0 doc_id rank score tag`` with six decimals, in topic and rank order.

    Topics that are numbers come first, by value; others follow by their text.
    """
    ordered = run.orderBy(F.col("qid").try_cast("bigint").asc_nulls_last(), "qid", "rank")
    return ordered.select(
        F.format_string("%s Q0 %s %d %.6f %s", F.col("qid"), F.col("doc_id").cast("string"), F.col("rank"), F.col("score"), F.lit(tag)).alias("value")
    )


def scored_lines(scored: DataFrame, tag: str = "LUCENE") -> DataFrame:
    """``qid Q0 doc_id 0 score tag`` for pairs scored by a model."""
    return scored.select(
        F.format_string("%s Q0 %s 0 %.6f %s", F.col("qid"), F.col("doc_id").cast("string"), F.col("score"), F.lit(tag)).alias("value")
    )


def ltr_lines(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """``grade qid:q 1:v 2:v ... # doc_id`` with single-precision values at six decimals."""
    values = [F.format_string(f"{i}:%.6f", F.col(n).cast("float").cast("double")) for i, n in enumerate(names, 1)]
    return features.select(
        F.concat_ws(
            " ", F.col("grade").cast("string"), F.concat(F.lit("qid:"), F.col("qid")), *values, F.lit("#"), F.col("doc_id").cast("string")
        ).alias("value")
    )


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    lines.select("value").write.mode(mode).option("compression", compression).text(path)


def write_run(run: DataFrame, path: str, tag: str) -> None:
    write_lines(run_lines(run, tag), path)


def write_scored(scored: DataFrame, path: str, tag: str = "LUCENE") -> None:
    write_lines(scored_lines(scored, tag), path)


def write_ltr(features: DataFrame, path: str, names: Sequence[str]) -> None:
    """Feature lines below ``path`` and the feature names, numbered, below ``path``-names."""
    write_lines(ltr_lines(features, names), path)
    header = features.sparkSession.createDataFrame([(f"#{i}:{n}",) for i, n in enumerate(names, 1)], "value string")
    write_lines(header.coalesce(1), f"{path}-names")


def write_ids(ids: DataFrame, path: str) -> None:
    """One id per line."""
    write_lines(ids.select(F.col(ids.columns[0]).cast("string").alias("value")), path)


def write_stoplist(terms: DataFrame, path: str) -> None:
    """One term per line; ``top_df_terms`` makes the choice."""
    write_lines(terms.select(F.col("term").alias("value")), path)


def write_dataset(rows: DataFrame, dictionary: DataFrame, path: str, as_text: bool = False) -> None:
    """Labelled vectors and their dictionary as tables, optionally also as lines."""
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    dictionary.write.mode("errorifexists").parquet(f"{path}/dictionary")
    if as_text:
        write_lines(rows.select(F.concat_ws("\t", "id", "city", "user_id", "vec", "text").alias("value")), f"{path}/rows-text")
        write_lines(dictionary.select(F.concat_ws(" ", "term", "term_id", "df").alias("value")), f"{path}/dictionary-text")
