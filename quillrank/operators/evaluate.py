"""Quality of a run against relevance judgments; relevant means a grade above 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sizing import lookup_join
from .rerank import is_judged


def _relevant(qrels: DataFrame) -> DataFrame:
    return qrels.where(F.col("grade") > 0).select("qid", "doc_id").distinct()


def average_precision(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``(qid, ap)`` for queries with relevant documents.

    Only the relevant documents of the run enter the window; the others count through their rank.
    """
    relevant = _relevant(qrels)
    found = lookup_join(run.select("qid", "doc_id", "rank"), relevant, ["qid", "doc_id"], "left_semi")
    seen = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    gains = found.select("qid", (seen / F.col("rank")).alias("precision")).groupBy("qid").agg(F.sum("precision").alias("gain"))
    sizes = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("n_relevant"))
    return sizes.join(gains, "qid", "left").select(
        "qid", (F.coalesce("gain", F.lit(0.0)) / F.col("n_relevant")).alias("ap")
    )


def mean_average_precision(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return average_precision(run, qrels).agg(F.round(F.avg("ap"), 6).alias("map"))


def precision_at(run: DataFrame, qrels: DataFrame, k: int = 30) -> DataFrame:
    """Mean over queries with relevant documents of the relevant share of the first k ranks."""
    relevant = _relevant(qrels)
    top = run.where(F.col("rank") <= k).select("qid", "doc_id")
    found = lookup_join(top, relevant, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    queries = relevant.select("qid").distinct()
    per_query = queries.join(found, "qid", "left").select((F.coalesce("n", F.lit(0)) / F.lit(k)).alias("p"))
    return per_query.agg(F.round(F.avg("p"), 6).alias("precision"))


def judged_share(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Share of the run that has a grade."""
    return is_judged(run, qrels).agg(F.round(F.avg(F.col("judged").cast("double")), 6).alias("share"))
