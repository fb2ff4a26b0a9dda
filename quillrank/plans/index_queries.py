"""Text functions, index build and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stemming import stem_sql
from ..functions.stemming import stem_terms as stem_distinct
from ..operators import postings as po
from ..operators import ranking as rk
from ..operators import segments as sg
from ..operators import vectors as vec
from ..session import fresh_path
from . import fixtures as fx
from .registry import query

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in tx.ENGLISH_STOPWORDS) + "]"
JOINED = "array_to_string({}, ' ')"


@query("analyze", fx.sql("SELECT doc_id, array_to_string(toks, ' ') AS tokens FROM toks", "toks"))
def analyze(spark, sf):
    return po.analyze(fx.corpus(spark, sf)).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query(
    "analyze_english",
    fx.sql(f"SELECT doc_id, array_to_string(list_filter(toks, lambda t: NOT list_contains({STOP_SQL}, t)), ' ') AS tokens FROM toks", "toks"),
)
def analyze_english(spark, sf):
    docs = po.analyze(fx.corpus(spark, sf), analyzer=tx.english_tokens)
    return docs.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


_DELIMS = "[" + "".join("\\" + c if c in "[]\\^-" else c for c in tx.STATUS_DELIMITERS) + "]"
_URL = tx.URL_TOKEN.replace("'", "''")
_STATUS_TOKENS_SQL = f"""
WITH words AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS w, generate_subscripts(string_split_regex(text, '\\s+'), 1) AS i FROM documents),
parts AS (SELECT doc_id, i, unnest(list_filter(string_split(s, ' '), lambda p: p <> '')) AS p,
  generate_subscripts(list_filter(string_split(s, ' '), lambda p: p <> ''), 1) AS j
  FROM (SELECT doc_id, i, regexp_replace(w, '(?i)({_DELIMS.replace("'", "''")})(https?://)', '\\1 \\2', 'g') AS s FROM words WHERE w <> '')),
pieces AS (SELECT doc_id, i, j, p, p AS c, true AS url, 1 AS k FROM parts WHERE regexp_matches(p, '{_URL}')
  UNION ALL SELECT doc_id, i, j, p, unnest(x), false, generate_subscripts(x, 1)
  FROM (SELECT *, string_split(regexp_replace(p, '{_DELIMS.replace("'", "''")}', ' ', 'g'), ' ') AS x FROM parts WHERE NOT regexp_matches(p, '{_URL}'))),
marked AS (SELECT doc_id, i, j, k, url, CASE WHEN url OR NOT regexp_matches(c, '[.&]') THEN c ELSE
  array_to_string(list_transform(range(1, length(c) + 1), lambda n: CASE
    WHEN c[n] = '.' AND ((n > 2 AND c[n-2] <> '.') OR (n + 2 <= length(c) AND c[n+2] <> '.')) THEN ' '
    WHEN c[n] = '&' AND (n = 1 OR n = length(c) OR regexp_full_match(c[n-1], '\\p{{Ll}}') OR regexp_full_match(c[n+1], '\\p{{Ll}}')) THEN ' '
    ELSE c[n] END), '') END AS c FROM pieces),
subs AS (SELECT doc_id, i, j, k, url, unnest(string_split(c, ' ')) AS s, generate_subscripts(string_split(c, ' '), 1) AS m FROM marked WHERE NOT url
  UNION ALL SELECT doc_id, i, j, k, url, c, 1 FROM marked WHERE url),
outs AS (SELECT doc_id, i, j, k, m, CASE WHEN url THEN [s]
  WHEN regexp_matches(s, '{tx.MENTION_TOKEN}') OR regexp_matches(s, '{tx.HASHTAG_TOKEN}') THEN [lower(s)]
  ELSE list_transform(string_split(regexp_replace(lower(s), '[{tx.ENTITY_DELIMITERS}]', ' ', 'g'), ' '),
    lambda t: regexp_replace(t, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) END AS ts FROM subs)
SELECT doc_id, array_to_string(list_filter(flatten(list(ts ORDER BY i, j, k, m)), lambda t: t <> ''), ' ') AS tokens
FROM outs GROUP BY doc_id
"""


@query("analyze_statuses", _STATUS_TOKENS_SQL)
def analyze_statuses(spark, sf):
    docs = po.analyze(fx.corpus(spark, sf), analyzer=tx.status_tokens)
    return docs.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("query_tokens", fx.sql("SELECT qid, pos::INT AS pos, term FROM qtok", "qtok"))
def query_tokens(spark, sf):
    return rk.analyze_topics(fx.topics(spark, sf))


@query(
    "remove_stopwords",
    f"""SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '' AND NOT list_contains({STOP_SQL}, w)), ' ') AS text
    FROM documents""",
)
def remove_stopwords(spark, sf):
    return fx.corpus(spark, sf).select("doc_id", tx.remove_stopwords("text", tx.ENGLISH_STOPWORDS).alias("text"))


_NAMES = "MAP {" + ", ".join(f"'{name}': '{char.replace(chr(39), chr(39) * 2)}'" for name, char in tx.named_characters().items()) + "}"


def _html_sql(col: str) -> str:
    out = col
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<[^>]*>"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    head = "regexp_extract(p, '^[^;]*;')"
    char = f"""CASE WHEN regexp_matches(p, '{tx.DECIMAL_REFERENCE}') THEN chr(regexp_extract(p, '[0-9]+')::INT) ELSE {_NAMES}[{head}] END"""
    part = f"coalesce({char} || substr(p, length({head}) + 1), '&' || p)"
    resolved = f"list_transform(string_split({out}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {part} END)"
    return f"trim(regexp_replace(array_to_string({resolved}, ''), '[ \\t\\r\\n]+', ' ', 'g'))"


#: Text behind each page that holds references of all kinds, rare names and what only looks like one.
_REFERENCES = " &rarr; &CounterClockwiseContourIntegral;&notin;&AMP; &amp;lt; &nosuch; & &; &eacute &#233; &fjlig;"


@query(
    "html_to_text",
    f"SELECT page_id, {_html_sql('html')} AS text FROM (SELECT page_id, html || '{_REFERENCES}' AS html FROM pages)",
)
def html_to_text(spark, sf):
    pages = fx.table(spark, sf, "pages").select("page_id", F.concat("html", F.lit(_REFERENCES)).alias("html"))
    return pages.select("page_id", tx.html_to_text("html").alias("text"))


@query(
    "url_domain",
    "SELECT page_id, regexp_replace(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), ''), '^www\\.', '') AS domain FROM pages",
)
def url_domain(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", tx.url_domain("url").alias("domain"))


@query("fold_newlines", "SELECT doc_id, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS text FROM documents")
def fold_newlines(spark, sf):
    return fx.corpus(spark, sf).select("doc_id", tx.fold_newlines("text").alias("text"))


@query(
    "count_substr",
    "SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::INT AS n_the, (length(text) - length(replace(text, '#', '')))::INT AS n_hash FROM documents",
)
def count_substr(spark, sf):
    return fx.corpus(spark, sf).select(
        "doc_id", tx.count_substr("text", "the").alias("n_the"), tx.count_substr("text", "#").alias("n_hash")
    )


@query("get_json", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def get_json(spark, sf):
    return fx.table(spark, sf, "events").select(
        "event_id", tx.get_json("props", "$.k", "none").alias("k"), tx.get_json("props", "$.missing", "none").alias("missing")
    )


@query("date_to_epoch", "SELECT event_id, epoch_us(ts) // 1000000 AS epoch FROM events")
def date_to_epoch(spark, sf):
    """Writes each time as status date text and reads it back."""
    ts = F.date_format(F.col("ts").cast("timestamp"), "EEE MMM d HH:mm:ss")
    text = F.concat(ts, F.lit(" +0000 "), F.date_format(F.col("ts").cast("timestamp"), "yyyy"))
    return fx.table(spark, sf, "events").select("event_id", tx.to_epoch(text).alias("epoch"))


@query("parse_count", "SELECT event_id, CASE WHEN value >= 100 THEN 100 ELSE floor(value)::INT END AS n FROM events")
def parse_count(spark, sf):
    text = F.when(F.col("value") >= 100, F.lit("100+")).otherwise(F.floor("value").cast("string"))
    return fx.table(spark, sf, "events").select("event_id", tx.parse_count(text).alias("n"))


@query("stem_terms", fx.sql(f"SELECT term, ({stem_sql('[term]')})[1] AS stem FROM terms", "terms"))
def stem_terms(spark, sf):
    words = po.analyze(fx.corpus(spark, sf)).select(F.explode("tokens").alias("term"))
    return stem_distinct(words)


@query("stem_postings", fx.sql("SELECT doc_id, term, tf::INT AS tf, dl::INT AS dl FROM spostings JOIN lengths USING (doc_id)", "spostings", "lengths"))
def stem_postings(spark, sf):
    return po.stem_postings(po.build_postings(fx.corpus(spark, sf))).select("doc_id", "term", "tf", "dl")


@query(
    "build_postings",
    fx.sql(
        "SELECT doc_id, term, tf::INT AS tf, array_to_string(positions, ' ') AS positions, dl::INT AS dl FROM postings JOIN lengths USING (doc_id)",
        "postings", "lengths",
    ),
)
def build_postings(spark, sf):
    return po.build_postings(fx.corpus(spark, sf)).withColumn("positions", F.array_join("positions", " "))


@query("doc_lengths", fx.sql("SELECT doc_id, sum(tf)::BIGINT AS dl FROM postings GROUP BY doc_id", "postings"))
def doc_lengths(spark, sf):
    return po.doc_lengths(po.build_postings(fx.corpus(spark, sf), positions=False))


@query("term_stats", fx.sql("SELECT term, df, ctf FROM terms", "terms"))
def term_stats(spark, sf):
    return fx.index(spark, sf).terms


@query("coll_stats", fx.sql("SELECT n_docs, sum_dl, round(avgdl, 6) AS avgdl FROM stats", "stats"))
def coll_stats(spark, sf):
    return fx.index(spark, sf).stats.withColumn("avgdl", F.round("avgdl", 6))


@query("stored_index", fx.sql("SELECT term, df, ctf, (SELECT sum_dl FROM stats) AS sum_dl FROM terms", "terms", "stats"))
def stored_index(spark, sf):
    """Index written, compacted, opened again and summed up."""
    path = fresh_path(spark, "index")
    po.write_index(fx.corpus(spark, sf), path, buckets=8)
    po.compact(spark, path, f"{path}-compact", 4)
    index = po.read_index(spark, f"{path}-compact")
    return po.term_stats(index.postings).withColumn("sum_dl", index.stat("sum_dl"))


@query("appended_index", fx.sql("SELECT term, df, ctf FROM terms", "terms"))
def appended_index(spark, sf):
    """One index built in two appends: documents with and without labels."""
    docs, labelled = fx.corpus(spark, sf), fx.table(spark, sf, "labels").select("doc_id").distinct()
    path = fresh_path(spark, "index")
    po.write_index(docs.join(labelled, "doc_id", "left_semi"), path, positions=False, buckets=8)
    po.write_index(docs.join(labelled, "doc_id", "left_anti"), path, "append", positions=False, buckets=8)
    return po.read_index(spark, path).terms.select("term", "df", "ctf")


@query("changed_index", fx.sql("SELECT term, df, ctf, (SELECT n_docs FROM stats) AS n_docs, (SELECT sum_dl FROM stats) AS sum_dl FROM terms", "terms", "stats"))
def changed_index(spark, sf):
    """Additions, updates and deletes, a segment each, leave what a fresh build of the documents has.

    Unlabelled documents come first, then labelled ones with a text that is not theirs and ids that no document has;
    an append that repeats everything skips what is there, an update brings the right texts, a delete takes the other ids out.
    """
    docs, labelled = fx.corpus(spark, sf), fx.table(spark, sf, "labels").select("doc_id").distinct()
    wrong = docs.join(labelled, "doc_id", "left_semi").withColumn("text", F.concat("text", F.lit(" gone")))
    strange = docs.select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    path = fresh_path(spark, "index")
    sg.create(spark, path, positions=False, term_buckets=8, doc_buckets=8)
    sg.change(spark, path, docs.join(labelled, "doc_id", "left_anti"))
    sg.change(spark, path, wrong.unionByName(strange), update=False)
    sg.change(spark, path, docs.withColumn("text", F.lit("skipped")), update=False)
    sg.change(spark, path, docs.join(labelled, "doc_id", "left_semi"))
    sg.change(spark, path, deletes=strange)
    index = sg.read_segments(spark, path)
    return index.terms.select("term", "df", "ctf", index.stat("n_docs").alias("n_docs"), index.stat("sum_dl").alias("sum_dl"))


@query("term_dictionary", fx.sql("SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df FROM terms", "terms"))
def term_dictionary(spark, sf):
    return po.term_dictionary(po.build_postings(fx.corpus(spark, sf), positions=False))


@query("collection_summary", "SELECT count(*) AS n, min(doc_id) AS min_id, max(doc_id) AS max_id FROM documents")
def collection_summary(spark, sf):
    return po.coverage(fx.statuses(spark, sf))


@query("query_term_counts", fx.sql("SELECT qid, term, qtf::INT AS qtf FROM qterms", "qterms"))
def query_term_counts(spark, sf):
    return rk.query_term_counts(rk.analyze_topics(fx.topics(spark, sf)))


@query("distinct_query_terms", fx.sql("SELECT qid, count(DISTINCT term) AS n FROM qtok GROUP BY qid", "qtok"))
def distinct_query_terms(spark, sf):
    return rk.analyze_topics(fx.topics(spark, sf)).groupBy("qid").agg(F.countDistinct("term").alias("n"))


@query("vector_from_terms", fx.sql("SELECT doc_id, term, count(*)::DOUBLE AS weight FROM tokens GROUP BY doc_id, term", "tokens"))
def vector_from_terms(spark, sf):
    words = po.analyze(fx.corpus(spark, sf)).select("doc_id", F.explode("tokens").alias("term"))
    return vec.vector_from_terms(words, "doc_id")


def _vectors(spark, sf):
    postings = po.build_postings(fx.corpus(spark, sf), positions=False)
    return postings.select("doc_id", "term", F.col("tf").cast("double").alias("weight"))


@query("vector_norms", fx.sql("SELECT doc_id, sum(tf)::DOUBLE AS l1, round(sqrt(sum(tf * tf)), 6) AS l2 FROM postings GROUP BY doc_id", "postings"))
def vector_norms(spark, sf):
    return vec.norms(_vectors(spark, sf), "doc_id").withColumn("l2", F.round("l2", 6))


@query(
    "normalize_l2",
    fx.sql("SELECT doc_id, term, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 6) AS weight FROM postings", "postings"),
)
def normalize_l2(spark, sf):
    return vec.normalize(_vectors(spark, sf), "doc_id", "l2").withColumn("weight", F.round("weight", 6)).select("doc_id", "term", "weight")


@query(
    "normalize_l1",
    fx.sql("SELECT doc_id, term, round(tf / sum(tf) OVER (PARTITION BY doc_id), 6) AS weight FROM postings", "postings"),
)
def normalize_l1(spark, sf):
    return vec.normalize(_vectors(spark, sf), "doc_id").withColumn("weight", F.round("weight", 6)).select("doc_id", "term", "weight")


@query(
    "prune_vectors",
    fx.sql(
        """SELECT doc_id, term, tf::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rn
        FROM postings) WHERE rn <= 20""",
        "postings",
    ),
)
def prune_vectors(spark, sf):
    return vec.prune(_vectors(spark, sf), "doc_id", 20)


_DOC_AND_TOPIC = ("SELECT doc_id % (SELECT count(*) FROM benchmark) AS k, term, sum(tf)::DOUBLE AS weight FROM postings GROUP BY ALL", "SELECT qid::BIGINT AS k, term, qtf::DOUBLE AS weight FROM qterms")


@query(
    "interpolate_vectors",
    fx.sql(
        f"""SELECT k, term, round(coalesce(0.6 * x.weight, 0) + coalesce(0.4 * y.weight, 0), 6) AS weight
        FROM ({_DOC_AND_TOPIC[1]}) x FULL JOIN ({_DOC_AND_TOPIC[0]}) y USING (k, term)""",
        "postings", "qterms",
    ),
)
def interpolate_vectors(spark, sf):
    n = fx.table(spark, sf, "benchmark").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    docs = _vectors(spark, sf).withColumn("k", F.col("doc_id") % n)
    query_terms = rk.query_term_counts(rk.analyze_topics(fx.topics(spark, sf)))
    queries = query_terms.select(F.col("qid").cast("bigint").alias("k"), "term", F.col("qtf").alias("weight"))
    mixed = vec.interpolate(queries, vec.vector_from_terms(docs, "k"), "k", 0.6)
    return mixed.withColumn("weight", F.round("weight", 6))


@query("vocabulary_union", fx.sql("SELECT term FROM terms UNION SELECT term FROM qterms", "terms", "qterms"))
def vocabulary_union(spark, sf):
    return vec.vocabulary(fx.index(spark, sf).terms, rk.analyze_topics(fx.topics(spark, sf)))


@query(
    "top_df_terms",
    fx.sql("SELECT term, df FROM terms ORDER BY df DESC, term DESC LIMIT 100", "terms"),
)
def top_df_terms(spark, sf):
    return rk.top_df_terms(fx.index(spark, sf).terms, 100)
