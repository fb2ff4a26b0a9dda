"""Ranking of whole topic sets: one join of query terms with postings, arithmetic, top-k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import materialize
from ..sizing import SMALL_ROWS, fits, lookup_join, split_hot_join
from .filters import as_of
from .postings import Analyzer, TermIndex, narrowed, stemmed, term_bucket

#: Scores are ranked at the precision of the run file, so that the order in which a cluster adds
#: floating-point numbers cannot change a rank when a task is run again.
SCORE_DIGITS = 6
#: Ranks up to which Spark keeps the best rows of a window per task before the shuffle.
GROUP_LIMIT = 1_000
#: Pieces in which the matches of a query are ranked first, beyond that.
RANK_PIECES = 64


def analyze_topics(topics: DataFrame, analyzer: Analyzer = tokens, stem: bool = False) -> DataFrame:
    """``(qid, pos, term)``: query tokens in order, with repeats, empty tokens dropped.

    ``stem`` turns them into the stems that a stemmed index has.
    """
    words = F.filter((stemmed(analyzer) if stem else analyzer)(F.col("query")), lambda t: t != "")
    return topics.select("qid", F.posexplode(words).alias("pos", "term"))


def query_term_counts(query_tokens: DataFrame) -> DataFrame:
    """``(qid, term, qtf)``."""
    return query_tokens.groupBy("qid", "term").agg(F.count(F.lit(1)).cast("int").alias("qtf"))


def topic_terms(topics: DataFrame, analyzer: Analyzer = tokens, stem: bool = False) -> DataFrame:
    """``(qid, term, weight, max_id)`` of a bag-of-words query; a repeated term weighs more."""
    counts = query_term_counts(analyze_topics(topics, analyzer, stem)).withColumnRenamed("qtf", "weight")
    if "max_id" not in topics.columns:
        return counts.withColumn("max_id", F.lit(None).cast("bigint"))
    return counts.join(topics.select("qid", "max_id"), "qid")


def with_term_stats(query_terms: DataFrame, index: TermIndex) -> DataFrame:
    """Query terms that occur in the collection, with df and ctf (and the bucket of a stored index)."""
    vocab = query_terms.select("term").where(F.length("term") > 0).distinct()  # a test that lets Spark prune by these terms
    keys = ["term"]
    if index.term_buckets:  # only the folders of the query terms are read
        vocab, keys = vocab.withColumn("term_bucket", term_bucket(F.col("term"), index.term_buckets)), ["term_bucket", "term"]
    if fits(query_terms):
        vocab = F.broadcast(vocab)
    found = index.terms.join(vocab, keys, "left_semi")
    # One row per distinct query term, so it is no larger than the query side itself.
    known = query_terms.join(found, "term")
    # Stored before it prunes the scan of the postings: the pruning would otherwise read the statistics once more, and whole.
    return materialize(known, "query-terms") if index.term_buckets else known


def match_terms(postings: DataFrame, query_terms: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """Postings of the query terms; documents match if they contain any of them.

    A query side of proven size is broadcast: postings are then not shuffled at all, so a term
    that occurs everywhere costs no more than its rows. With a stored index the join also
    carries the bucket directory of the term, and only those directories are read. A query
    side beyond the bound is joined by shuffle with hot terms split over many tasks.
    """
    keys = ["term_bucket", "term"] if "term_bucket" in postings.columns and "term_bucket" in query_terms.columns else ["term"]
    query_terms = query_terms.where(F.length("term") > 0)
    if fits(query_terms if bound is None else bound, SMALL_ROWS):
        return postings.join(F.broadcast(query_terms), keys)
    return split_hot_join(postings, query_terms, keys, "inner", "doc_id", stored="term_bucket" in keys)


@dataclass(frozen=True)
class Model:
    """A term score in two parts.

    ``constant`` depends on the term only (df, ctf, collection statistics) and is computed once
    per query term, as column ``_c``, before the postings are met. ``score`` is computed per
    posting from ``_c``, tf and dl.
    """

    constant: Column
    score: Column


def bm25_model(index: TermIndex, k1: float = 0.9, b: float = 0.4) -> Model:
    idf = F.log(1 + (index.stat("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / index.stat("avgdl"))
    return Model(idf, F.col("_c") * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + norm))


def dirichlet_model(index: TermIndex, mu: float = 1000.0, floor: bool = False) -> Model:
    """``floor`` keeps each term score at 0 or above."""
    weight = F.lit(mu) * (F.col("ctf") / index.stat("sum_dl"))
    score = F.log(1 + F.col("tf") / F.col("_c")) + F.log(F.lit(mu) / (F.col("dl") + F.lit(mu)))
    return Model(weight, F.greatest(score, F.lit(0.0)) if floor else score)


def tfidf_model(index: TermIndex) -> Model:
    idf = 1 + F.log(index.stat("n_docs") / (F.col("df") + 1))
    return Model(idf * idf, F.sqrt("tf") * F.col("_c"))


def score_weighted(index: TermIndex, weighted_terms: DataFrame, model: Model) -> DataFrame:
    """``(qid, doc_id, score, n_terms)``: weighted sum of term scores over matching documents."""
    index = narrowed(index, weighted_terms)
    terms = with_term_stats(weighted_terms, index).withColumn("_c", model.constant)
    matches = match_terms(index.postings.drop("positions"), terms, bound=weighted_terms)
    visible = matches.where(as_of(F.col("doc_id"), F.col("max_id")))
    return visible.groupBy("qid", "doc_id").agg(
        F.sum(F.col("weight") * model.score).alias("score"), F.count(F.lit(1)).alias("n_terms")
    )


def matching_pairs(index: TermIndex, topics: DataFrame, analyzer: Analyzer = tokens) -> DataFrame:
    """``(qid, doc_id, dl)``: each topic with the documents that hold any of its terms.

    Pairs without a common term are not formed; most features are constant for them.
    """
    wanted = topic_terms(topics, analyzer, index.stemmed)
    index = narrowed(index, wanted)
    matches = match_terms(index.postings.drop("positions"), with_term_stats(wanted, index), bound=wanted)
    return matches.groupBy("qid", "doc_id").agg(F.first("dl").alias("dl"))


def top_k(scored: DataFrame, k: int = 1000, *, recent_first: bool = False) -> DataFrame:
    """``run(qid, doc_id, score, rank)``: the best k per query, ranks from 1.

    The matches of a query are dealt over RANK_PIECES pieces by a hash of the document; each keeps its best
    k before the pieces meet, so the last step sees at most RANK_PIECES * k rows of a query however many
    documents match and however large k is.
    """
    tie = F.desc("doc_id") if recent_first else F.asc("doc_id")
    rounded = scored.withColumn("score", F.round("score", SCORE_DIGITS))
    if k > GROUP_LIMIT:  # up to this bound each task keeps its best k by itself
        piece = F.pmod(F.xxhash64("doc_id"), F.lit(RANK_PIECES))
        own = Window.partitionBy("qid", "_piece").orderBy(F.desc("score"), tie)
        dealt = rounded.withColumn("_piece", piece).withColumn("_rank", F.row_number().over(own))
        rounded = dealt.where(F.col("_rank") <= k).drop("_piece", "_rank")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), tie)
    return rounded.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _run(scored: DataFrame, hits: int) -> DataFrame:
    return top_k(scored.select("qid", "doc_id", "score"), hits)


def bm25(index: TermIndex, topics: DataFrame, k1: float = 0.9, b: float = 0.4, hits: int = 1000, analyzer: Analyzer = tokens) -> DataFrame:
    terms = topic_terms(topics, analyzer, index.stemmed)
    index = narrowed(index, terms)
    return _run(score_weighted(index, terms, bm25_model(index, k1, b)), hits)


def query_likelihood(
    index: TermIndex, topics: DataFrame, mu: float = 1000.0, hits: int = 1000, analyzer: Analyzer = tokens, floor: bool = False
) -> DataFrame:
    """Dirichlet-smoothed query likelihood; ``floor`` keeps each term score at 0 or above."""
    terms = topic_terms(topics, analyzer, index.stemmed)
    index = narrowed(index, terms)
    return _run(score_weighted(index, terms, dirichlet_model(index, mu, floor)), hits)


def tfidf(index: TermIndex, topics: DataFrame, hits: int = 1000, analyzer: Analyzer = tokens) -> DataFrame:
    """TF-IDF with the share of matched query terms as a factor."""
    terms = topic_terms(topics, analyzer, index.stemmed)
    index = narrowed(index, terms)
    length = terms.groupBy("qid").agg(F.sum("weight").alias("qlen"))
    scored = score_weighted(index, terms, tfidf_model(index))
    scored = lookup_join(scored, length, "qid", spread_on="doc_id", bound=topics)
    return _run(scored.withColumn("score", F.col("score") * F.col("n_terms") / F.col("qlen")), hits)


def search(index: TermIndex, text: str, n: int = 20, analyzer: Analyzer = tokens) -> DataFrame:
    """``(doc_id, score)``: the best n documents for one query text, by TF-IDF."""
    topic = index.postings.sparkSession.sql("SELECT 'q' AS qid, :text AS query", args={"text": text})
    run = tfidf(index, topic, n, analyzer)
    return run.orderBy(F.desc("score"), "doc_id").limit(n).select("doc_id", "score")


def match_all(df: DataFrame, condition: Column) -> tuple[int, DataFrame]:
    """Number of hits, and all of them without a limit."""
    hits = df.where(condition)
    return hits.count(), hits


def order_recent(run: DataFrame) -> DataFrame:
    """Score descending, id descending."""
    return run.orderBy(F.desc("score"), F.desc("doc_id"))


def top_df_terms(terms: DataFrame, k: int = 100) -> DataFrame:
    """The k terms with the largest df (larger term first on ties), in ascending order."""
    return terms.select("term", "df").orderBy(F.desc("df"), F.desc("term")).limit(k).orderBy("df", "term")
