"""Whole runs: index statuses or pages, rank a topic set, rerank, in one call each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .feedback import rm3
from .filters import index_statuses
from .postings import Analyzer, TermIndex, build_index
from .ranking import Model, bm25_model, dirichlet_model, score_weighted, tfidf_model, top_k, topic_terms
from .rerank import Reranker, cascade, tiebreak_recent

MODELS = {"bm25": bm25_model, "ql": dirichlet_model, "tfidf": tfidf_model}


def rank_topics(
    index: TermIndex,
    topics: DataFrame,
    model: str | Model = "bm25",
    feedback: bool = False,
    stop: DataFrame | None = None,
    rerankers: Sequence[Reranker] = (),
    hits: int = 1000,
    analyzer: Analyzer = tokens,
) -> DataFrame:
    """``run(qid, doc_id, score, rank)`` of a topic set, with optional feedback and rerankers.

    ``model`` is ``bm25``, ``ql``, ``tfidf`` or a model of your own. With ``feedback`` the query
    is expanded from its first run. Rerankers are applied in order.
    """
    scorer = MODELS[model](index) if isinstance(model, str) else model
    scored = score_weighted(index, topic_terms(topics, analyzer, index.stemmed), scorer).select("qid", "doc_id", "score")
    run = top_k(scored, hits)
    if feedback:
        run = rm3(index, topics, run, scorer, stop, hits=hits, analyzer=analyzer)
    return cascade(run, *rerankers)


def status_run(
    statuses: DataFrame,
    topics: DataFrame,
    deletes: DataFrame | None = None,
    max_id: int | None = None,
    model: str = "ql",
    feedback: bool = False,
    stop: DataFrame | None = None,
    hits: int = 1000,
    analyzer: Analyzer = tokens,
) -> DataFrame:
    """Rank statuses for timed topics: delete list and id cap first, then ranking among the
    statuses older than the topic, then retweets out and ties broken by recency."""
    kept = index_statuses(statuses, deletes, max_id)
    index = build_index(kept, "id", "text", positions=False, analyzer=analyzer)
    flags = kept.select(F.col("id").alias("doc_id"), "retweeted_status_id")
    return rank_topics(
        index, topics, model, feedback, stop, [lambda run: tiebreak_recent(run, flags)], hits, analyzer
    )
