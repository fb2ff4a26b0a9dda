"""Reranking of runs. A reranker is a function from a run to a run, applied with ``transform``."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sizing import lookup_join
from .filters import drop_retweets
from .ranking import top_k

Reranker = Callable[[DataFrame], DataFrame]

#: Scores this close to the one before are a tie; tied scores are moved apart by TIE_STEP.
TIE_WIDTH = 0.001
TIE_STEP = 0.000001


def cascade(run: DataFrame, *rerankers: Reranker) -> DataFrame:
    """Apply rerankers in order."""
    for reranker in rerankers:
        run = run.transform(reranker)
    return run


def tiebreak_recent(run: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """Drop retweets, order by score and recency, and set tied scores apart.

    ``run`` has at most the hits of a query per qid. Retweets are known from a column
    ``retweeted_status_id`` of the run, or from ``statuses(doc_id, retweeted_status_id)``.
    """
    if statuses is not None:
        retweets = statuses.where(F.col("retweeted_status_id").isNotNull()).select("doc_id")
        run = run.join(retweets, "doc_id", "left_anti")
    else:
        run = drop_retweets(run)
    unique = run.select("qid", "doc_id", "score").dropDuplicates(["qid", "doc_id", "score"])
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("doc_id"))
    gap = F.abs(F.col("score") - F.lag("score", 1, 0.0).over(order)) > TIE_WIDTH
    marked = unique.withColumn("_new", gap.cast("int")).withColumn(
        "_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    in_island = Window.partitionBy("qid", "_island").orderBy(F.desc("score"), F.desc("doc_id"))
    # The first score of a query is compared with 0, so island 0 holds ties without a leader.
    nth = F.row_number().over(in_island) - F.when(F.col("_island") > 0, 1).otherwise(0)
    return marked.select(
        "qid",
        "doc_id",
        (F.col("score") - F.lit(TIE_STEP) * nth).alias("score"),
        F.row_number().over(order).alias("rank"),
    )


def linear_model(weights: Mapping[str, float], bias: float = 0.0) -> Reranker:
    """Model over feature columns: the weighted sum plus a bias."""

    def score(features: DataFrame) -> DataFrame:
        total = F.lit(float(bias))
        for name, weight in weights.items():
            total = total + F.col(name) * F.lit(float(weight))
        return features.withColumn("score", total)

    return score


def ml_model(model, names: list[str]) -> Reranker:
    """A fitted ``pyspark.ml`` regression model over the named feature columns."""
    from pyspark.ml.feature import VectorAssembler

    assembler = VectorAssembler(inputCols=names, outputCol=model.getFeaturesCol(), handleInvalid="error")

    def score(features: DataFrame) -> DataFrame:
        scored = model.transform(assembler.transform(features))
        return scored.select(*features.columns, F.col(model.getPredictionCol()).alias("score"))

    return score


def score_features(features: DataFrame, model: Reranker) -> DataFrame:
    """``(qid, doc_id, score)``: one line per pair of a feature table."""
    return model(features).select("qid", "doc_id", F.round("score", 6).alias("score"))


def rerank_by_model(features: DataFrame, model: Reranker, hits: int | None = None) -> DataFrame:
    """Run ordered by model score, then by id, both descending; the best ``hits`` of each query, all without it.

    With a bound the pairs of a query are ranked in pieces first, however many it has.
    """
    scored = score_features(features, model)
    if hits is not None:
        return top_k(scored, hits, recent_first=True)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order))


@dataclass(frozen=True)
class Split:
    """A node of a regression tree: values of ``feature`` up to ``threshold`` go to ``low``, others to ``high``; a number is a leaf."""

    feature: str
    threshold: float
    low: Split | float
    high: Split | float


def tree_column(node: Split | float) -> Column:
    """A tree as one column expression."""
    if not isinstance(node, Split):
        return F.lit(float(node))
    return F.when(F.col(node.feature) <= F.lit(node.threshold), tree_column(node.low)).otherwise(tree_column(node.high))


def tree_sql(node: Split | float) -> str:
    """The same as SQL text."""
    if not isinstance(node, Split):
        return f"{float(node)!r}::DOUBLE"
    return f'CASE WHEN "{node.feature}" <= {node.threshold!r} THEN {tree_sql(node.low)} ELSE {tree_sql(node.high)} END'


def tree_model(trees: Sequence[tuple[float, Split | float]]) -> Reranker:
    """Scorer of an ensemble of ``(weight, tree)``: no worker leaves the JVM, and the plan holds the whole model."""

    def score(features: DataFrame) -> DataFrame:
        total = reduce(add, (F.lit(float(w)) * tree_column(t) for w, t in trees), F.lit(0.0))
        return features.withColumn("score", total)

    return score


def trees_sql(trees: Sequence[tuple[float, Split | float]]) -> str:
    """Score of an ensemble as SQL text."""
    return " + ".join(["0.0", *(f"{float(w)!r}::DOUBLE * {tree_sql(t)}" for w, t in trees)])


def trees_of(model, names: Sequence[str]) -> list[tuple[float, Split | float]]:
    """Trees of a fitted ``pyspark.ml`` regression ensemble over the features ``names``; its splits must be numeric."""

    def read(lines: list[str]) -> Split | float:
        line = lines.pop(0).strip()
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        found = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
        if found is None:
            raise ValueError(f"no numeric split: {line}")
        low = read(lines)
        lines.pop(0)  # the opposite test
        return Split(names[int(found[1])], float(found[2]), low, read(lines))

    return [(float(w), read(tree.toDebugString.strip().splitlines()[1:])) for w, tree in zip(model.treeWeights, model.trees)]


def with_grade(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Run with the grade of each document; unjudged and negative grades become 0."""
    joined = lookup_join(run, qrels.select("qid", "doc_id", "grade"), ["qid", "doc_id"], "left")
    return joined.withColumn("grade", F.greatest(F.coalesce("grade", F.lit(0)), F.lit(0)))


def is_judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Run with a flag that tells if the pair has a grade at all."""
    marked = qrels.select("qid", "doc_id", F.lit(True).alias("judged"))
    return lookup_join(run, marked, ["qid", "doc_id"], "left").withColumn("judged", F.coalesce("judged", F.lit(False)))
