"""Ranking, feedback, reranking and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stemming import stem_sql
from ..operators import evaluate as ev
from ..operators import feedback as fb
from ..operators import filters as fl
from ..operators import postings as po
from ..operators import ranking as rk
from ..operators import rerank as rr
from ..operators import runs
from ..session import fresh_path
from ..sinks import files as out
from ..sources import judgments as jd
from . import fixtures as fx
from .registry import query

_BM25 = "ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))"
_QL = "(ln(1 + tf / (1000.0 * ctf / sum_dl)) + ln(1000.0 / (dl + 1000.0)))"


def _topk(scored: str, k: int = 1000) -> str:
    return f"""SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank
    FROM ({scored})) WHERE rank <= {k}"""


def _sum(expr: str, where: str = "") -> str:
    return f"SELECT qid, doc_id, round(sum(qtf * {expr}), 6) AS score FROM matches, stats {where} GROUP BY qid, doc_id"


def bm25_run(spark, sf):
    return rk.bm25(fx.index(spark, sf), fx.topics(spark, sf))


@query("bm25", fx.sql(_topk(_sum(_BM25)), "matches", "stats"))
def bm25(spark, sf):
    return bm25_run(spark, sf)


@query("bm25_top10", fx.sql(_topk(_sum(_BM25), 10), "matches", "stats"))
def bm25_top10(spark, sf):
    return rk.bm25(fx.index(spark, sf), fx.topics(spark, sf), hits=10)


@query(
    "bm25_stemmed",
    fx.sql(
        _topk(f"""SELECT qid, doc_id, round(sum(qtf * {_BM25}), 6) AS score
        FROM (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({stem_sql('q')}) AS term FROM qtoks) GROUP BY qid, term) JOIN spostings USING (term)
        JOIN lengths USING (doc_id) JOIN (SELECT term, count(*) AS df FROM spostings GROUP BY term) USING (term), stats GROUP BY qid, doc_id"""),
        "qtoks", "spostings", "lengths", "stats",
    ),
)
def bm25_stemmed(spark, sf):
    """A stored index of stems, and stemmed topics."""
    path = fresh_path(spark, "index")
    po.write_index(fx.corpus(spark, sf), path, positions=False, stem=True, buckets=8)
    return rk.bm25(po.read_index(spark, path), fx.topics(spark, sf))


@query("bm25_stored", fx.sql(_topk(_sum(_BM25)), "matches", "stats"))
def bm25_stored(spark, sf):
    path = fresh_path(spark, "index")
    po.write_index(fx.corpus(spark, sf), path, positions=False, buckets=8)
    return rk.bm25(po.read_index(spark, path), fx.topics(spark, sf))


@query(
    "bm25_as_of",
    fx.sql(_topk(_sum(_BM25, "JOIN topics USING (qid) WHERE doc_id BETWEEN 0 AND max_id").replace("FROM matches, stats", "FROM stats, matches")), "matches", "stats", "topics"),
)
def bm25_as_of(spark, sf):
    return rk.bm25(fx.index(spark, sf), fx.timed_topics(spark, sf))


@query("query_likelihood", fx.sql(_topk(_sum(_QL)), "matches", "stats"))
def query_likelihood(spark, sf):
    return rk.query_likelihood(fx.index(spark, sf), fx.topics(spark, sf))


_TFIDF = """SELECT qid, doc_id, round(sum(qtf * sqrt(tf) * (1 + ln(n_docs / (df + 1))) * (1 + ln(n_docs / (df + 1)))) * count(*) / max(qlen), 6) AS score
    FROM matches JOIN qlen USING (qid), stats GROUP BY qid, doc_id"""


@query("tfidf", fx.sql(_topk(_TFIDF), "matches", "qlen", "stats"))
def tfidf(spark, sf):
    return rk.tfidf(fx.index(spark, sf), fx.topics(spark, sf))


@query(
    "search_one_query",
    fx.sql(f"SELECT doc_id, score FROM ({_topk(_TFIDF, 20)}) WHERE qid = '0'", "matches", "qlen", "stats"),
)
def search_one_query(spark, sf):
    text = fx.topics(spark, sf).where("qid = '0'").first()["query"]
    return rk.search(fx.index(spark, sf), text, 20)


@query("result_ids", fx.sql(f"SELECT doc_id FROM ({_topk(_TFIDF, 20)}) WHERE qid = '0'", "matches", "qlen", "stats"))
def result_ids(spark, sf):
    return search_one_query(spark, sf).select("doc_id")


@query(
    "match_terms",
    fx.sql("SELECT qid, doc_id, term, qtf::INT AS weight, tf::INT AS tf, dl::INT AS dl, df, ctf FROM matches", "matches"),
)
def match_terms(spark, sf):
    wanted = rk.topic_terms(fx.topics(spark, sf)).drop("max_id")
    index = po.narrowed(fx.index(spark, sf), wanted)
    return rk.match_terms(index.postings, rk.with_term_stats(wanted, index), bound=wanted).select("qid", "doc_id", "term", "weight", "tf", "dl", "df", "ctf")


@query(
    "weighted_terms",
    fx.sql(_topk(_sum("(1.0 / qlen) * " + _BM25).replace("FROM matches, stats", "FROM stats, matches JOIN qlen USING (qid)")), "matches", "stats", "qlen"),
)
def weighted_terms(spark, sf):
    from ..operators.vectors import normalize

    weighted = normalize(rk.topic_terms(fx.topics(spark, sf)), "qid", "l1")
    index = po.narrowed(fx.index(spark, sf), weighted)
    return rk.top_k(rk.score_weighted(index, weighted, rk.bm25_model(index, 0.9, 0.4)).drop("n_terms"))


@query(
    "match_all",
    "SELECT doc_id AS id, (SELECT count(*) FROM documents WHERE lang = 'en') AS n_hits FROM documents WHERE lang = 'en'",
)
def match_all(spark, sf):
    n, hits = rk.match_all(fx.statuses(spark, sf), F.col("lang") == "en")
    return hits.select("id", F.lit(n).cast("bigint").alias("n_hits"))


@query("expansion_terms", fx.sql("""SELECT doc_id, term, tf::INT AS tf FROM postings WHERE length(term) >= 2 AND regexp_full_match(term, '[a-z0-9]+')
    AND term NOT IN (SELECT term FROM (SELECT term FROM terms ORDER BY df DESC, term DESC LIMIT 100))""", "postings", "terms"))
def expansion_terms(spark, sf):
    index = fx.index(spark, sf)
    return fl.expansion_terms(index.postings.select("doc_id", "term", "tf"), rk.top_df_terms(index.terms))


_RM3_SQL = f"""
, fbdocs AS MATERIALIZED (SELECT qid, doc_id, score FROM ({{first}}) WHERE rank <= 50),
dv AS MATERIALIZED (SELECT qid, doc_id, score, term, tf::DOUBLE AS w FROM (
  SELECT f.qid, f.doc_id, f.score, p.term, p.tf, row_number() OVER (PARTITION BY f.qid, f.doc_id ORDER BY p.tf DESC, p.term) AS rn
  FROM fbdocs f JOIN postings p USING (doc_id) WHERE length(p.term) >= 2
  AND p.term NOT IN (SELECT term FROM (SELECT term FROM terms ORDER BY df DESC, term DESC LIMIT 100))) WHERE rn <= 20),
dm AS MATERIALIZED (SELECT qid, term, round(sum(w / l1 * score), 12) AS w FROM (SELECT *, sum(w) OVER (PARTITION BY qid, doc_id) AS l1 FROM dv) GROUP BY qid, term),
pr AS MATERIALIZED (SELECT qid, term, w / sum(w) OVER (PARTITION BY qid) AS w FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY w DESC, term) AS rn FROM dm) WHERE rn <= 20),
orig AS MATERIALIZED (SELECT qid, term, qtf::DOUBLE / qlen AS w FROM qterms JOIN qlen USING (qid)),
ex AS MATERIALIZED (SELECT qid, term, sum(w) AS w FROM (SELECT qid, term, 0.6 * w AS w FROM orig UNION ALL SELECT qid, term, 0.4 * w FROM pr) GROUP BY qid, term),
scored AS (SELECT e.qid, p.doc_id, round(sum(e.w * {{model}}), 6) AS score
  FROM ex e JOIN postings p USING (term) JOIN lengths l USING (doc_id) JOIN terms t USING (term), stats GROUP BY e.qid, p.doc_id)
"""


def _rm3_sql(model: str) -> str:
    base = fx.sql("", "matches", "stats", "qlen").rstrip()
    return base + _RM3_SQL.replace("{first}", _topk(_sum(model))).replace("{model}", model) + _topk("SELECT * FROM scored")


@query("rm3_bm25", _rm3_sql(_BM25))
def rm3_bm25(spark, sf):
    index, topics = fx.index(spark, sf), fx.topics(spark, sf)
    stop = rk.top_df_terms(index.terms)
    return fb.rm3(index, topics, rk.bm25(index, topics), rk.bm25_model(index, 0.9, 0.4), stop)


@query("rm3_query_likelihood", _rm3_sql(_QL))
def rm3_query_likelihood(spark, sf):
    index, topics = fx.index(spark, sf), fx.topics(spark, sf)
    stop = rk.top_df_terms(index.terms)
    return fb.rm3(index, topics, rk.query_likelihood(index, topics), rk.dirichlet_model(index, 1000.0), stop)


@query("rm3_stored", _rm3_sql(_BM25))
def rm3_stored(spark, sf):
    """Feedback documents are read from the table of documents, by the folders of their ids."""
    index, topics = fx.stored_index(spark, sf), fx.topics(spark, sf)
    stop = rk.top_df_terms(index.terms)
    return fb.rm3(index, topics, rk.bm25(index, topics), rk.bm25_model(index, 0.9, 0.4), stop)


_TIES = fx.sql(
    """SELECT qid, doc_id, round(score - 0.000001 * (row_number() OVER (PARTITION BY qid, island ORDER BY score DESC, doc_id DESC)
      - CASE WHEN island > 0 THEN 1 ELSE 0 END), 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC)::INT AS rank
    FROM (SELECT *, sum(new) OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC ROWS UNBOUNDED PRECEDING) AS island
      FROM (SELECT qid, doc_id, score, (abs(score - lag(score, 1, 0.0) OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC)) > 0.001)::INT AS new
        FROM (SELECT DISTINCT qid, doc_id, score FROM bm25_run JOIN statuses ON id = doc_id WHERE retweeted_status_id IS NULL)))""",
    "bm25_run", "statuses",
)


def _retweet_flags(spark, sf):
    return fx.statuses(spark, sf).select(F.col("id").alias("doc_id"), "retweeted_status_id")


@query("tiebreak_recent", _TIES)
def tiebreak_recent(spark, sf):
    run = rr.tiebreak_recent(bm25_run(spark, sf), _retweet_flags(spark, sf))
    return run.withColumn("score", F.round("score", 9))


@query("reranker_cascade", _TIES)
def reranker_cascade(spark, sf):
    """Retweets are dropped by one reranker and ties are broken by the next."""
    flags = _retweet_flags(spark, sf)
    run = rr.cascade(
        bm25_run(spark, sf),
        lambda r: fl.drop_retweets(r.join(flags, "doc_id")),
        rr.tiebreak_recent,
        lambda r: r.withColumn("score", F.round("score", 9)),
    )
    return run.select("qid", "doc_id", "score", "rank")


@query(
    "order_recent",
    fx.sql("SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC)::INT AS rank FROM bm25_run", "bm25_run"),
)
def order_recent(spark, sf):
    return rk.top_k(bm25_run(spark, sf).drop("rank"), recent_first=True)


@query(
    "with_grade",
    fx.sql("SELECT qid, doc_id, score, greatest(coalesce(grade, 0), 0) AS grade FROM bm25_run LEFT JOIN qrels USING (qid, doc_id)", "bm25_run", "qrels"),
)
def with_grade(spark, sf):
    return rr.with_grade(bm25_run(spark, sf).drop("rank"), fx.qrels(spark, sf)).select("qid", "doc_id", "score", "grade")


@query(
    "is_judged",
    fx.sql("SELECT qid, doc_id, grade IS NOT NULL AS judged FROM bm25_run LEFT JOIN qrels USING (qid, doc_id)", "bm25_run", "qrels"),
)
def is_judged(spark, sf):
    return rr.is_judged(bm25_run(spark, sf), fx.qrels(spark, sf)).select("qid", "doc_id", "judged")


_REL = """, rel AS (SELECT DISTINCT qid, doc_id FROM qrels WHERE grade > 0),
hit AS (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS seen FROM bm25_run JOIN rel USING (qid, doc_id)),
ap AS (SELECT qid, coalesce((SELECT sum(seen / rank) FROM hit h WHERE h.qid = r.qid), 0) / count(*) AS ap,
  (SELECT count(*) FROM hit h WHERE h.qid = r.qid AND rank <= 30) / 30 AS p30 FROM rel r GROUP BY qid)
"""


def _eval_sql(select: str) -> str:
    return fx.sql("", "bm25_run", "qrels").rstrip() + _REL + select


@query("average_precision", _eval_sql("SELECT qid, round(ap, 6) AS ap FROM ap"))
def average_precision(spark, sf):
    return ev.average_precision(bm25_run(spark, sf), fx.qrels(spark, sf)).withColumn("ap", F.round("ap", 6))


@query("mean_average_precision", _eval_sql("SELECT round(avg(ap), 6) AS map FROM ap"))
def mean_average_precision(spark, sf):
    return ev.mean_average_precision(bm25_run(spark, sf), fx.qrels(spark, sf))


@query("precision_at_30", _eval_sql("SELECT round(avg(p30), 6) AS precision FROM ap"))
def precision_at_30(spark, sf):
    return ev.precision_at(bm25_run(spark, sf), fx.qrels(spark, sf), 30)


@query("judged_share", fx.sql("SELECT round(avg((grade IS NOT NULL)::INT), 6) AS share FROM bm25_run LEFT JOIN qrels USING (qid, doc_id)", "bm25_run", "qrels"))
def judged_share(spark, sf):
    return ev.judged_share(bm25_run(spark, sf), fx.qrels(spark, sf))


@query(
    "run_file",
    fx.sql("SELECT qid || ' Q0 ' || doc_id || ' ' || rank || ' ' || printf('%.6f', score) || ' bm25' AS value FROM bm25_run", "bm25_run"),
)
def run_file(spark, sf):
    path = fresh_path(spark, "run")
    out.write_run(bm25_run(spark, sf), path, "bm25")
    return spark.read.text(path)


@query("read_run", fx.sql("SELECT qid, doc_id::VARCHAR AS doc_id, score, rank::INT AS rank, 'bm25' AS tag FROM bm25_run", "bm25_run"))
def read_run(spark, sf):
    path = fresh_path(spark, "run")
    out.write_run(bm25_run(spark, sf), path, "bm25")
    return jd.read_run(spark, path)


@query("stop_list_file", fx.sql("SELECT term FROM terms ORDER BY df DESC, term DESC LIMIT 500", "terms"))
def stop_list_file(spark, sf):
    path = fresh_path(spark, "stop")
    out.write_stoplist(rk.top_df_terms(fx.index(spark, sf).terms, 500), path)
    return jd.read_stoplist(spark, path)


_STATUS_RUN = fx.sql("", "statuses", "deletes", "qterms", "topics").rstrip() + f"""
, kept AS MATERIALIZED (SELECT * FROM statuses WHERE id NOT IN (SELECT id FROM deletes)),
kt AS (SELECT id, unnest({fx.TOKENS.format('text')}) AS term FROM kept),
kp AS MATERIALIZED (SELECT id AS doc_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY id)::BIGINT AS dl FROM kt GROUP BY id, term),
ks AS MATERIALIZED (SELECT term, sum(tf)::BIGINT AS ctf FROM kp GROUP BY term),
sc AS (SELECT qid, doc_id, round(sum(qtf * (ln(1 + tf / (1000.0 * ctf / (SELECT sum(tf) FROM kp))) + ln(1000.0 / (dl + 1000.0)))), 6) AS score
  FROM qterms JOIN kp USING (term) JOIN ks USING (term) JOIN topics USING (qid) WHERE doc_id BETWEEN 0 AND max_id GROUP BY qid, doc_id),
rn AS (SELECT qid, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc) JOIN kept k ON k.id = doc_id
  WHERE rank <= 1000 AND k.retweeted_status_id IS NULL),
mk AS (SELECT *, (abs(score - lag(score, 1, 0.0) OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC)) > 0.001)::INT AS new FROM rn),
il AS (SELECT *, sum(new) OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC ROWS UNBOUNDED PRECEDING) AS island FROM mk)
SELECT qid, doc_id, round(score - 0.000001 * (row_number() OVER (PARTITION BY qid, island ORDER BY score DESC, doc_id DESC)
  - CASE WHEN island > 0 THEN 1 ELSE 0 END), 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC)::INT AS rank FROM il"""


@query("status_run", _STATUS_RUN)
def status_run(spark, sf):
    """Delete list, as-of query likelihood, retweet removal and tie-break in one job."""
    run = runs.status_run(fx.statuses(spark, sf), fx.timed_topics(spark, sf), fx.deletes(spark, sf))
    return run.withColumn("score", F.round("score", 9))
