"""Inputs of the registered queries, derived from the test tables.

Each fixture exists twice: as a DataFrame and as a common table expression. Whole tables and
whole texts are used throughout; a topic is the whole text of a ``benchmark`` row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import stem_sql
from ..operators import segments
from ..operators.postings import TermIndex, build_index, numbered
from ..session import fresh_path

BASE_EPOCH = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def index(spark: SparkSession, sf_dir: str, positions: bool = False) -> TermIndex:
    return build_index(corpus(spark, sf_dir), positions=positions)


def stored_index(spark: SparkSession, sf_dir: str, positions: bool = False) -> TermIndex:
    """A stored index with both layouts: postings by term, documents by id."""
    path = fresh_path(spark, "index")
    segments.create(spark, path, positions=positions, term_buckets=8, doc_buckets=8)
    segments.change(spark, path, corpus(spark, sf_dir))
    return segments.read_segments(spark, path)


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))


def timed_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = table(spark, sf_dir, "documents").agg(F.max("doc_id").alias("m")).select("m").scalar()
    return topics(spark, sf_dir).withColumn("max_id", newest - F.col("qid").cast("bigint"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return table(spark, sf_dir, "labels").select(
        (F.col("doc_id") % n).cast("string").alias("qid"), "doc_id", (F.col("quality") - F.col("toxic")).alias("grade")
    )


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    points = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.element_at("embedding", 1).cast("double").alias("longitude"),
        F.element_at("embedding", 2).cast("double").alias("latitude"),
    )
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("user_url"))
    d = F.col("doc_id")
    return docs.join(points, "doc_id", "left").join(urls, "doc_id", "left").select(
        d.alias("id"),
        "text",
        F.concat(F.lit("user"), d % 97).alias("screen_name"),
        (d % 97).cast("string").alias("user_id"),
        (F.lit(BASE_EPOCH) + 60 * d).alias("epoch"),
        F.col("source").alias("place"),
        F.when((d % 5 == 0) & (d >= 7), d - 7).alias("in_reply_to_status_id"),
        F.when((d % 5 == 0) & (d >= 7), (d - 7) % 97).alias("in_reply_to_user_id"),
        F.when((d % 11 == 0) & (d > 0), d - 1).alias("retweeted_status_id"),
        F.when((d % 11 == 0) & (d > 0), (d - 1) % 97).alias("retweeted_user_id"),
        F.when((d % 11 == 0) & (d > 0), d % 150).cast("int").alias("retweet_count"),
        "longitude",
        "latitude",
        "lang",
        (F.col("n_chars") % 1000).cast("int").alias("followers_count"),
        (F.col("n_chars") % 377).cast("int").alias("friends_count"),
        F.col("n_chars").cast("int").alias("statuses_count"),
        F.concat(F.lit("in "), F.col("source")).alias("user_location"),
        F.concat_ws(" ", F.lit("writes"), "lang", F.lit("from"), "source").alias("user_description"),
        "user_url",
    )


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One city per place of the statuses, centred on the point of the first document from there."""
    sources = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("vec_id"))
    points = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.element_at("embedding", 1).cast("double").alias("lon"), F.element_at("embedding", 2).cast("double").alias("lat")
    )
    return sources.join(points, "vec_id").select(
        F.col("vec_id").cast("int").alias("city_no"), F.col("source").alias("name"),
        F.array(F.concat("source", F.lit(", XX"))).alias("aliases"), "lon", "lat",
    )


def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")).distinct()


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic = 1").select((F.col("doc_id") % 97).cast("string").alias("user_id")).distinct()


def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 97).cast("string").alias("user_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(own.alias("id"), F.when(F.col("turn") > 0, own - 1).alias("in_reply_to_status_id"))


def messages(events: DataFrame) -> DataFrame:
    """Adds and deletes of a batch or a stream of events."""
    is_delete = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(is_delete, "delete").otherwise("add").alias("op"),
        F.when(is_delete, F.col("event_id") - 3).otherwise(F.col("event_id")).alias("id"),
        "user_id", "event_type", "value",
    )


def ranked_vectors(spark: SparkSession, sf_dir: str, terms: DataFrame) -> DataFrame:
    """Vectors for the most frequent terms: rank of the term = number of the vector.

    Only as many terms as there are vectors are ranked, by range partitions and offsets.
    """
    points = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    frequent = terms.orderBy(F.desc("ctf"), "term").limit(points.count())
    ranked = numbered(frequent.select("term", (-F.col("ctf")).alias("down")), "down", "term")
    return ranked.select("term", F.col("n").alias("vec_id")).join(points, "vec_id").select("term", "embedding")


#: The sum of place times value of a vector, in both engines.
WEIGHTED_SQL = "round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 6)"


def weighted(vector: str) -> Column:
    terms = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(terms, F.lit(0.0), lambda total, x: total + x), 6)


TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"

CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "toks": ((), f"SELECT doc_id, {TOKENS.format('text')} AS toks FROM documents"),
    "tokens": (("toks",), "SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM toks"),
    "postings": (
        ("tokens",),
        "SELECT doc_id, term, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM tokens GROUP BY doc_id, term",
    ),
    "stoks": (("toks",), f"SELECT doc_id, {stem_sql('toks')} AS toks FROM toks"),
    "stokens": (("stoks",), "SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM stoks"),
    "spostings": (("stokens",), "SELECT doc_id, term, count(*) AS tf FROM stokens GROUP BY doc_id, term"),
    "lengths": (("toks",), "SELECT doc_id, len(toks) AS dl FROM toks"),
    "terms": (("postings",), "SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM postings GROUP BY term"),
    "stats": (
        ("lengths",),
        "SELECT count(*) AS n_docs, sum(dl)::BIGINT AS sum_dl, sum(dl)::DOUBLE / count(*) AS avgdl FROM lengths",
    ),
    "topics": (
        (),
        "SELECT item_id::VARCHAR AS qid, text AS query, (SELECT max(doc_id) FROM documents) - item_id AS max_id FROM benchmark",
    ),
    "qtoks": (("topics",), f"SELECT qid, {TOKENS.format('query')} AS q FROM topics"),
    "qtok": (("qtoks",), "SELECT qid, unnest(q) AS term, generate_subscripts(q, 1) - 1 AS pos FROM qtoks"),
    "qterms": (("qtok",), "SELECT qid, term, count(*) AS qtf FROM qtok GROUP BY qid, term"),
    "qlen": (("qterms",), "SELECT qid, sum(qtf)::BIGINT AS qlen, count(*) AS n_unique FROM qterms GROUP BY qid"),
    "matches": (
        ("qterms", "postings", "lengths", "terms"),
        "SELECT q.qid, p.doc_id, term, q.qtf, p.tf, p.positions, l.dl, t.df, t.ctf"
        " FROM qterms q JOIN postings p USING (term) JOIN lengths l USING (doc_id) JOIN terms t USING (term)",
    ),
    "qrels": (
        (),
        "SELECT (doc_id % (SELECT count(*) FROM benchmark))::VARCHAR AS qid, doc_id, quality - toxic AS grade FROM labels",
    ),
    "statuses": (
        (),
        f"""SELECT d.doc_id AS id, d.text, 'user' || (d.doc_id % 97) AS screen_name, (d.doc_id % 97)::VARCHAR AS user_id,
        {BASE_EPOCH} + 60 * d.doc_id AS epoch, d.source AS place,
        CASE WHEN d.doc_id % 5 = 0 AND d.doc_id >= 7 THEN d.doc_id - 7 END AS in_reply_to_status_id,
        CASE WHEN d.doc_id % 5 = 0 AND d.doc_id >= 7 THEN (d.doc_id - 7) % 97 END AS in_reply_to_user_id,
        CASE WHEN d.doc_id % 11 = 0 AND d.doc_id > 0 THEN d.doc_id - 1 END AS retweeted_status_id,
        CASE WHEN d.doc_id % 11 = 0 AND d.doc_id > 0 THEN (d.doc_id - 1) % 97 END AS retweeted_user_id,
        (CASE WHEN d.doc_id % 11 = 0 AND d.doc_id > 0 THEN d.doc_id % 150 END)::INT AS retweet_count,
        e.embedding[1]::DOUBLE AS longitude, e.embedding[2]::DOUBLE AS latitude, d.lang,
        (d.n_chars % 1000)::INT AS followers_count, (d.n_chars % 377)::INT AS friends_count,
        d.n_chars::INT AS statuses_count, 'in ' || d.source AS user_location,
        concat_ws(' ', 'writes', d.lang, 'from', d.source) AS user_description, p.url AS user_url
        FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id""",
    ),
    "cities": (
        (),
        """SELECT s.vec_id::INT AS city_no, s.source AS name, [s.source || ', XX'] AS aliases,
        e.embedding[1]::DOUBLE AS lon, e.embedding[2]::DOUBLE AS lat
        FROM (SELECT source, min(doc_id) AS vec_id FROM documents GROUP BY source) s JOIN embeddings e USING (vec_id)""",
    ),
    "deletes": ((), "SELECT DISTINCT doc_id AS id FROM labels WHERE toxic = 1"),
    "cohort": ((), "SELECT DISTINCT (doc_id % 97)::VARCHAR AS user_id FROM labels WHERE toxic = 1"),
    "timelines": ((), "SELECT (conv_id % 97)::VARCHAR AS user_id, conv_id * 1000 + turn AS id, text FROM conversations"),
    "replies": (
        (),
        "SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS in_reply_to_status_id"
        " FROM conversations",
    ),
    "messages": (
        (),
        """SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END AS op,
        CASE WHEN event_type = 'error' THEN event_id - 3 ELSE event_id END AS id, user_id, event_type, value FROM events""",
    ),
    "live": (
        ("messages",),
        """SELECT id, seq, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn
        FROM messages) WHERE rn = 1 AND op = 'add'""",
    ),
    "city_hits": (
        ("statuses", "cities"),
        """SELECT s.*, c.city_no, c.name AS city FROM statuses s JOIN cities c
        ON (s.longitude BETWEEN c.lon - 0.05 AND c.lon + 0.05 AND s.latitude BETWEEN c.lat - 0.05 AND c.lat + 0.05)
        OR s.place = c.name OR list_contains(c.aliases, s.place)""",
    ),
    "bm25_scored": (
        ("matches", "stats"),
        """SELECT qid, doc_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 1.9
        / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))), 6) AS score FROM matches, stats GROUP BY qid, doc_id""",
    ),
    "bm25_run": (
        ("bm25_scored",),
        """SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
        FROM bm25_scored) WHERE rank <= 1000""",
    ),
    "vectors": (
        ("terms",),
        """SELECT term, embedding FROM (SELECT term, row_number() OVER (ORDER BY ctf DESC, term) - 1 AS vec_id FROM terms) r
        JOIN embeddings USING (vec_id)""",
    ),
}


def sql(body: str, *names: str) -> str:
    """``body`` with the named common table expressions, and those they need, in front."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in CTE[name][0]:
            need(dep)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n][1]})" for n in order) + "\n" + body
