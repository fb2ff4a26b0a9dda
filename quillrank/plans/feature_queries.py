"""Query-document features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import joins as jn
from ..operators import ranking as rk
from ..operators import rerank as rr
from ..session import fresh_path
from ..sinks import files as out
from ..sources import judgments as jd
from . import fixtures as fx
from .registry import query

_IDF = "ln(1 + (n_docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))"
_TIDF = "(1 + ln(n_docs / (df + 1)))"
_BM25F = "ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"

_QUERY_CTES = f"""
, qf AS MATERIALIZED (SELECT qid, max(qlen) AS qlen, max(n_unique) AS n_unique, sum(qtf * {_IDF}) / max(qlen) AS avg_idf,
  coalesce(sum(CASE WHEN ctf > 0 THEN qtf * (1 + ln(ctf * {_IDF})) END), 0) / max(qlen) AS avg_scq,
  coalesce(sum(CASE WHEN ctf > 0 THEN qtf / qlen * ln((qtf / qlen) / (ctf / sum_dl)) END), 0) AS clarity
  FROM qterms JOIN qlen USING (qid) LEFT JOIN terms USING (term), stats GROUP BY qid),
qp AS MATERIALIZED (SELECT a.qid, a.term AS t1, b.term AS t2, coalesce(ta.df, 0) AS df1, coalesce(tb.df, 0) AS df2
  FROM qterms a JOIN qterms b ON a.qid = b.qid AND a.term < b.term LEFT JOIN terms ta ON ta.term = a.term LEFT JOIN terms tb ON tb.term = b.term),
co AS MATERIALIZED (SELECT x.t1, x.t2, count(*) AS n FROM (SELECT DISTINCT t1, t2 FROM qp) x JOIN postings p1 ON p1.term = x.t1
  JOIN postings p2 ON p2.term = x.t2 AND p2.doc_id = p1.doc_id GROUP BY x.t1, x.t2),
pm AS MATERIALIZED (SELECT qid, avg(coalesce(ln(n / (df1::DOUBLE * df2)), 0)) AS pmi FROM qp LEFT JOIN co USING (t1, t2) GROUP BY qid)
"""

_PAIR_CTES = """
, nx AS (SELECT DISTINCT a.qid, a.term AS a, b.term AS b FROM qtok a JOIN qtok b ON a.qid = b.qid AND b.pos = a.pos + 1),
al AS (SELECT DISTINCT a.qid, a.term AS a, b.term AS b FROM qtok a JOIN qtok b ON a.qid = b.qid AND b.pos > a.pos),
lastplace AS (SELECT qid, term, max(pos) AS pos FROM qtok q WHERE pos < (SELECT max(pos) FROM qtok x WHERE x.qid = q.qid) GROUP BY qid, term),
oa AS (SELECT DISTINCT a.qid, a.term AS a, b.term AS b FROM lastplace a JOIN qtok b ON a.qid = b.qid AND b.pos > a.pos),
w AS MATERIALIZED (SELECT qid, t1, t2, sum(os)::INT AS ordered_next, sum(us)::INT AS unordered_next, sum(oal)::INT AS ordered_all, sum(ual)::INT AS unordered_all FROM (
  SELECT qid, a AS t1, b AS t2, 1 AS os, 1 AS us, 0 AS oal, 0 AS ual FROM nx UNION ALL SELECT qid, b, a, 0, 1, 0, 0 FROM nx
  UNION ALL SELECT qid, a, b, 0, 0, 1, 0 FROM oa UNION ALL SELECT qid, a, b, 0, 0, 0, 1 FROM al UNION ALL SELECT qid, b, a, 0, 0, 0, 1 FROM al) GROUP BY qid, t1, t2)
"""

_POSITION_CTES = """
, mp AS MATERIALIZED (SELECT qid, doc_id, term, unnest(positions) AS pos FROM ({pairs}) JOIN matches USING (qid, doc_id)),
near AS MATERIALIZED (SELECT x.qid, x.doc_id, x.term AS t1, y.term AS t2, y.pos - x.pos AS distance FROM mp x JOIN mp y
  ON x.qid = y.qid AND x.doc_id = y.doc_id AND y.pos BETWEEN x.pos + 1 AND x.pos + 10)
"""

_GAPS = (6, 8, 10)
_KINDS = (("UnorderedSequentialPairs", "unordered_next"), ("OrderedSequentialPairs", "ordered_next"))
_ALL_KINDS = tuple((name, kind) for name, kind in ft.PAIR_KINDS.items())


def _counts(kinds, gaps) -> str:
    return ", ".join(f"sum(CASE WHEN distance <= {g} THEN {k} ELSE 0 END)::DOUBLE AS {n}{g}" for n, k in kinds for g in gaps)


def _wide_sql(pairs: str, extra: str = "", select: str = "", gaps=_GAPS, kinds=_KINDS, join: str = "") -> str:
    counted = _POSITION_CTES.format(pairs="SELECT qid, doc_id FROM prs") + (
        f", cnt AS (SELECT qid, doc_id, {_counts(kinds, gaps)} FROM near JOIN w USING (qid, t1, t2) GROUP BY qid, doc_id)"
    )
    if not kinds:
        counted = ""
    base = fx.sql("", "matches", "stats", "qlen", "qrels", "qtok", "bm25_run", "statuses").rstrip()
    features = ["coalesce(sum_tf, 0)::DOUBLE AS UnigramsFeatureExtractor"]
    features += [f"coalesce({n}{g}, 0)::DOUBLE AS {n}{g}" for n, _ in kinds for g in gaps]
    features += [
        "coalesce(n_match, 0)::DOUBLE AS MatchingTermCount", "qlen::DOUBLE AS QueryLength", "coalesce(sum_tf, 0)::DOUBLE AS SumMatchingTf",
        "coalesce(sum_tf, 0)::DOUBLE AS SumTermFrequency", "round(coalesce(bm, 0), 6) AS BM25Feature", "round(coalesce(ti * n_match / qlen, 0), 6) AS TFIDF",
        "n_unique::DOUBLE AS UniqueQueryTerms", "dl::DOUBLE AS DocSize", "round(coalesce(ic / qlen, 0), 6) AS AvgICTF", "round(avg_idf, 6) AS AvgIDF",
        "round(clarity, 6) AS SimplifiedClarityScore", "round(coalesce(pmi, 0), 6) AS PMIFeature", "round(avg_scq, 6) AS AvgSCQ",
    ]
    return (
        base + _QUERY_CTES + _PAIR_CTES + f", prs AS MATERIALIZED ({pairs})" + counted
        + f""", mt AS (SELECT qid, doc_id, count(*) AS n_match, sum(tf)::BIGINT AS sum_tf, sum({_BM25F}) AS bm, sum(qtf * sqrt(tf) * {_TIDF} * {_TIDF}) AS ti,
          sum(ln(dl / tf)) AS ic FROM matches JOIN prs USING (qid, doc_id), stats GROUP BY qid, doc_id)
        SELECT prs.qid, prs.doc_id, {extra}{', '.join(features)}{select} FROM prs JOIN lengths USING (doc_id) JOIN qf USING (qid) LEFT JOIN pm USING (qid)
        LEFT JOIN mt USING (qid, doc_id) {'LEFT JOIN cnt USING (qid, doc_id)' if kinds else ''} {join}"""
    )


def _rounded(df, names):
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, *(F.round(c, 6).alias(c) for c in names))


_JUDGED = "SELECT q.qid, doc_id, grade FROM qrels q JOIN lengths USING (doc_id) JOIN topics USING (qid) WHERE dl > 0"


@query("judged_pairs", fx.sql("SELECT q.qid, doc_id, grade, dl::INT AS dl FROM qrels q JOIN lengths USING (doc_id) JOIN topics USING (qid) WHERE dl > 0", "qrels", "lengths", "topics"))
def judged_pairs(spark, sf):
    return jn.judged_pairs(fx.qrels(spark, sf), fx.index(spark, sf), fx.topics(spark, sf)).select("qid", "doc_id", "grade", "dl")


@query("matching_pairs", fx.sql("SELECT DISTINCT qid, doc_id, dl::INT AS dl FROM qterms JOIN postings USING (term) JOIN lengths USING (doc_id)", "qterms", "postings", "lengths"))
def matching_pairs(spark, sf):
    return rk.matching_pairs(fx.index(spark, sf), fx.topics(spark, sf))


@query("features_judged", _wide_sql(_JUDGED, "grade, "))
def features_judged(spark, sf):
    found = ft.extract_judged(fx.qrels(spark, sf), fx.index(spark, sf, True), fx.topics(spark, sf))
    return _rounded(found, ft.WEB_FEATURES)


@query("features_judged_stored", _wide_sql(_JUDGED, "grade, "))
def features_judged_stored(spark, sf):
    """The same from a stored index: the judged documents are read by the folders of their ids."""
    found = ft.extract_judged(fx.qrels(spark, sf), fx.stored_index(spark, sf, True), fx.topics(spark, sf))
    return _rounded(found, ft.WEB_FEATURES)


@query("features_run", _wide_sql("SELECT qid, doc_id, score, greatest(coalesce(grade, 0), 0) AS grade FROM bm25_run LEFT JOIN qrels USING (qid, doc_id)", "grade, score, "))
def features_run(spark, sf):
    index, topics = fx.stored_index(spark, sf, True), fx.topics(spark, sf)
    found = ft.extract_run(rk.bm25(index, topics), fx.qrels(spark, sf), index, topics, with_score=True)
    return _rounded(found, ft.WEB_FEATURES)


@query(
    "features_matching",
    _wide_sql("SELECT qid, doc_id, greatest(coalesce(grade, 0), 0) AS grade FROM (SELECT DISTINCT qid, doc_id FROM qterms JOIN postings USING (term)) LEFT JOIN qrels USING (qid, doc_id)", "grade, "),
)
def features_matching(spark, sf):
    found = ft.extract_matching(fx.qrels(spark, sf), fx.index(spark, sf, True), fx.topics(spark, sf))
    return _rounded(found, ft.WEB_FEATURES)


@query(
    "features_statuses",
    _wide_sql(
        _JUDGED, "grade, ",
        """, ((length(s.text) - length(replace(s.text, 'http://', ''))) // 7)::DOUBLE AS TwitterLinkCount, s.followers_count::DOUBLE AS TwitterFollowerCount,
        s.friends_count::DOUBLE AS TwitterFriendCount, (s.in_reply_to_status_id IS NOT NULL)::INT::DOUBLE AS IsTweetReply,
        (length(s.text) - length(replace(s.text, '#', '')))::DOUBLE AS TwitterHashtagCount""",
        join="JOIN statuses s ON s.id = prs.doc_id",
    ),
)
def features_statuses(spark, sf):
    docs = fx.statuses(spark, sf).select(F.col("id").alias("doc_id"), "text", "followers_count", "friends_count", "in_reply_to_status_id")
    found = ft.extract_judged(fx.qrels(spark, sf), fx.index(spark, sf, True), fx.topics(spark, sf), ft.STATUS_FEATURES, docs)
    return _rounded(found, ft.STATUS_FEATURES)


_PAIR_GAPS = (1, 2, 4, 10)


@query(
    "features_pairs",
    fx.sql("", "matches", "qrels", "topics").rstrip() + _PAIR_CTES + f", prs AS MATERIALIZED ({_JUDGED})" + _POSITION_CTES.format(pairs="SELECT qid, doc_id FROM prs")
    + f", cnt AS (SELECT qid, doc_id, {_counts(_ALL_KINDS, _PAIR_GAPS)} FROM near JOIN w USING (qid, t1, t2) GROUP BY qid, doc_id) "
    + "SELECT qid, doc_id, grade, " + ", ".join(f"coalesce({n}{g}, 0)::DOUBLE AS {n}{g}" for n, _ in _ALL_KINDS for g in _PAIR_GAPS)
    + " FROM prs LEFT JOIN cnt USING (qid, doc_id)",
)
def features_pairs(spark, sf):
    """All four kinds of position pairs at several gaps."""
    names = [f"{n}{g}" for n in ft.PAIR_KINDS for g in _PAIR_GAPS]
    return ft.extract_judged(fx.qrels(spark, sf), fx.index(spark, sf, True), fx.topics(spark, sf), names)


@query(
    "position_pairs",
    fx.sql("", "matches", "qrels", "topics").rstrip() + f", prs AS ({_JUDGED})" + _POSITION_CTES.format(pairs="SELECT qid, doc_id FROM prs")
    + "SELECT qid, doc_id, t1, t2, distance::INT AS distance, count(*) AS n FROM near GROUP BY ALL",
)
def position_pairs(spark, sf):
    index, topics = fx.index(spark, sf, True), fx.topics(spark, sf)
    pairs = jn.judged_pairs(fx.qrels(spark, sf), index, topics)
    matches = ft.pair_matches(pairs, rk.analyze_topics(topics), index)
    near = ft.position_pairs(matches.groupBy("qid", "doc_id").agg(ft.token_sequence().alias("seq")), 10)
    return near.groupBy("qid", "doc_id", "t1", "t2", "distance").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sequential_dependence",
    fx.sql("", "matches", "qrels", "topics", "qlen").rstrip() + _PAIR_CTES + f", prs AS MATERIALIZED ({_JUDGED})" + _POSITION_CTES.format(pairs="SELECT qid, doc_id FROM prs")
    + """, adj AS (SELECT qid, count(*) AS n_adj FROM nx GROUP BY qid),
    pc AS (SELECT n.qid, doc_id, a, b, sum(CASE WHEN distance = 1 AND t1 = a AND t2 = b THEN 1 ELSE 0 END) AS o, sum((t1 = a AND t2 = b)::INT + (t1 = b AND t2 = a)::INT) AS u
      FROM near n JOIN nx ON n.qid = nx.qid AND ((t1 = a AND t2 = b) OR (t1 = b AND t2 = a)) WHERE distance <= 8 GROUP BY n.qid, doc_id, a, b),
    ps AS (SELECT qid, doc_id, sum(ln(o + 1)) AS so, sum(ln(u + 1)) AS su FROM pc GROUP BY qid, doc_id),
    ts AS (SELECT qid, doc_id, sum(ln(tf + 1)) AS st FROM matches GROUP BY qid, doc_id)
    SELECT qid, doc_id, grade, round(0.5 * (coalesce(st, 0) - n_unique * ln(dl + 1)) + 0.2 * (coalesce(so, 0) - coalesce(n_adj, 0) * ln(dl + 1))
      + 0.3 * (coalesce(su, 0) - coalesce(n_adj, 0) * ln(dl + 1)), 6) AS SDM
    FROM prs JOIN lengths USING (doc_id) JOIN qlen USING (qid) LEFT JOIN adj USING (qid) LEFT JOIN ts USING (qid, doc_id) LEFT JOIN ps USING (qid, doc_id)""",
)
def sequential_dependence(spark, sf):
    found = ft.extract_judged(fx.qrels(spark, sf), fx.index(spark, sf, True), fx.topics(spark, sf), ["SDM"])
    return _rounded(found, ["SDM"])


@query(
    "query_features",
    fx.sql("", "matches", "stats", "qlen").rstrip() + _QUERY_CTES
    + """SELECT qid, qlen, n_unique, round(avg_idf, 6) AS avg_idf, round(avg_scq, 6) AS avg_scq, round(clarity, 6) AS clarity, round(coalesce(pmi, 0), 6) AS pmi
    FROM qf LEFT JOIN pm USING (qid)""",
)
def query_features(spark, sf):
    found = ft.query_features(rk.analyze_topics(fx.topics(spark, sf)), fx.index(spark, sf))
    return _rounded(found, ["avg_idf", "avg_scq", "clarity", "pmi"])


@query(
    "cooccurrence",
    fx.sql("", "matches", "stats", "qlen").rstrip() + _QUERY_CTES + "SELECT t1, t2, n FROM co",
)
def cooccurrence(spark, sf):
    terms = rk.query_term_counts(rk.analyze_topics(fx.topics(spark, sf)))
    listed = terms.groupBy("qid").agg(F.sort_array(F.collect_set("term")).alias("ts"))
    first = listed.select(F.posexplode("ts").alias("i", "t1"), "ts")
    pairs = first.select("t1", F.explode(F.slice("ts", F.col("i") + 2, F.size("ts"))).alias("t2"))
    return jn.cooccurrence(fx.index(spark, sf).postings, pairs)


@query(
    "shared_docs",
    fx.sql(
        """, two AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) AS r FROM terms)
        SELECT doc_id FROM postings WHERE term = (SELECT term FROM two WHERE r = 1) INTERSECT SELECT doc_id FROM postings WHERE term = (SELECT term FROM two WHERE r = 2)""",
        "terms",
    ),
)
def shared_docs(spark, sf):
    index = fx.index(spark, sf)
    t1, t2 = (r["term"] for r in index.terms.orderBy(F.desc("df"), "term").limit(2).collect())
    return jn.shared_docs(index.postings, t1, t2)


_MODEL = {"BM25Feature": 0.7, "MatchingTermCount": 0.1, "DocSize": -0.0001}
_SCORED = _wide_sql(_JUDGED, "grade, ")
_SCORE = "round(0.25 + 0.7 * BM25Feature + 0.1 * MatchingTermCount - 0.0001 * DocSize, 6)"


def _small_features(spark, sf):
    names = list(_MODEL)
    return _rounded(ft.extract_judged(fx.qrels(spark, sf), fx.index(spark, sf), fx.topics(spark, sf), names), names)


@query("rerank_by_model", f"SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC)::INT AS rank FROM (SELECT qid, doc_id, {_SCORE} AS score FROM ({_SCORED}))")
def rerank_by_model(spark, sf):
    return rr.rerank_by_model(_small_features(spark, sf), rr.linear_model(_MODEL, 0.25))


@query("score_features", f"SELECT qid || ' Q0 ' || doc_id || ' 0 ' || printf('%.6f', {_SCORE}) || ' LUCENE' AS value FROM ({_SCORED})")
def score_features(spark, sf):
    """Feature table scored by a model and written as a run without ranks."""
    path = fresh_path(spark, "scored")
    out.write_scored(rr.score_features(_small_features(spark, sf), rr.linear_model(_MODEL, 0.25)), path)
    return spark.read.text(path)


_TREES = (
    (1.0, rr.Split("BM25Feature", 4.0005, rr.Split("MatchingTermCount", 2.5, 0.125, 0.25), rr.Split("DocSize", 300.5, 1.5, 1.0))),
    (0.5, rr.Split("DocSize", 120.5, rr.Split("BM25Feature", 1.0005, -0.5, 0.75), rr.Split("MatchingTermCount", 5.5, 0.0, 2.0))),
    (0.25, rr.Split("MatchingTermCount", 1.5, 0.0, 1.0)),
)


@query(
    "rerank_by_trees",
    f"""SELECT qid, doc_id, score, rank FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC)::INT AS rank
    FROM (SELECT qid, doc_id, round({rr.trees_sql(_TREES)}, 6) AS score FROM ({_SCORED}))) WHERE rank <= 20""",
)
def rerank_by_trees(spark, sf):
    """A boosted ensemble as one expression; the best 20 of each query."""
    return rr.rerank_by_model(_small_features(spark, sf), rr.tree_model(_TREES), 20)


@query("ltr_file", f"""SELECT grade || ' qid:' || qid || ' 1:' || printf('%.6f', SumMatchingTf) || ' 2:' || printf('%.6f', DocSize) || ' # ' || doc_id AS value FROM ({_SCORED})""")
def ltr_file(spark, sf):
    names = ["SumMatchingTf", "DocSize"]
    path = fresh_path(spark, "ltr")
    out.write_ltr(ft.extract_judged(fx.qrels(spark, sf), fx.index(spark, sf), fx.topics(spark, sf), names), path, names)
    return spark.read.text(path)


@query("read_ltr", f"SELECT qid, doc_id::VARCHAR AS doc_id, grade, SumMatchingTf AS f1, DocSize AS f2 FROM ({_SCORED})")
def read_ltr(spark, sf):
    names = ["SumMatchingTf", "DocSize"]
    path = fresh_path(spark, "ltr")
    out.write_ltr(ft.extract_judged(fx.qrels(spark, sf), fx.index(spark, sf), fx.topics(spark, sf), names), path, names)
    rows = jd.read_ltr(spark, path)
    return rows.select("qid", "doc_id", "grade", F.col("features")[0].alias("f1"), F.col("features")[1].alias("f2"))
