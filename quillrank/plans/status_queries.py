"""Filters over statuses, joins, city matching, user statistics and labelled vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import filters as fl
from ..operators import geo
from ..operators import joins as jn
from ..operators import postings as po
from ..operators import ranking as rk
from ..session import fresh_path, materialize
from ..sinks import files as out
from . import fixtures as fx
from .registry import query

# The place that plays the one city of the single-city jobs.
CITY = {"name": "src5", "short_name": "the", "lon": 0.02, "lat": -0.03}
_RELATED = """(coalesce(abs(longitude - 0.02) < 0.05 AND abs(latitude + 0.03) < 0.05, false) OR coalesce(contains(place, 'src5'), false)
  OR coalesce(contains(user_location, 'src5'), false) OR coalesce(contains(text, 'the'), false))"""
_TEXT_TOKENS = fx.TOKENS.format("text")


@query("only_responses", "SELECT doc_id, lang AS type FROM documents WHERE lang = 'en'")
def only_responses(spark, sf):
    """English documents play the response records."""
    records = fx.table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", "response").otherwise("warcinfo").alias("type"))
    return fl.only_responses(records).select("doc_id", F.lit("en").alias("type"))


@query("drop_empty", "SELECT doc_id FROM documents WHERE length(text) > 0 AND doc_id % 3 != 0")
def drop_empty(spark, sf):
    """Every third text is turned into blanks, tabs and line ends."""
    blank = F.regexp_replace("text", r"[^\n]", "\t ")
    docs = fx.corpus(spark, sf).withColumn("text", F.when(F.col("doc_id") % 3 == 0, blank).otherwise(F.col("text")))
    return fl.drop_empty(docs).select("doc_id")


@query("cap_id", fx.sql("SELECT id FROM statuses WHERE id <= (SELECT max(doc_id) - 40 FROM labels)", "statuses"))
def cap_id(spark, sf):
    newest = fx.table(spark, sf, "labels").agg(F.max("doc_id")).first()[0]
    return fl.cap_id(fx.statuses(spark, sf), newest - 40).select("id")


@query(
    "english_geo",
    fx.sql("SELECT id, place, longitude FROM statuses WHERE lang = 'en' AND (place IS NOT NULL OR (longitude IS NOT NULL AND latitude IS NOT NULL))", "statuses"),
)
def english_geo(spark, sf):
    return fl.english_geo(fx.statuses(spark, sf)).select("id", "place", "longitude")


@query("in_box", fx.sql("SELECT id FROM statuses WHERE longitude BETWEEN 0.0 AND 0.2 AND latitude BETWEEN -0.1 AND 0.1", "statuses"))
def in_box(spark, sf):
    return fx.statuses(spark, sf).where(fl.in_box(F.col("longitude"), F.col("latitude"), F.lit(0.1), F.lit(0.0), 0.1)).select("id")


@query("within_area", fx.sql("SELECT id FROM statuses WHERE abs(longitude - 0.1) < 0.05 AND abs(latitude - 0.0) < 0.05", "statuses"))
def within_area(spark, sf):
    return fx.statuses(spark, sf).where(fl.within_area(F.col("longitude"), F.col("latitude"), F.lit(0.1), F.lit(0.0))).select("id")


@query("place_is", fx.sql("SELECT id, place FROM statuses WHERE place IN ('src3', 'src4')", "statuses"))
def place_is(spark, sf):
    return fl.place_is(fx.statuses(spark, sf), ["src3", "src4"]).select("id", "place")


@query("city_related", fx.sql(f"SELECT id FROM statuses WHERE {_RELATED}", "statuses"))
def city_related(spark, sf):
    return fl.city_related(fx.statuses(spark, sf), **CITY).select("id")


@query("as_of", fx.sql("SELECT DISTINCT qid, doc_id FROM qterms JOIN postings USING (term) JOIN topics USING (qid) WHERE doc_id BETWEEN 0 AND max_id", "qterms", "postings", "topics"))
def as_of(spark, sf):
    topics = fx.timed_topics(spark, sf)
    pairs = rk.matching_pairs(fx.index(spark, sf), topics).join(F.broadcast(topics.select("qid", "max_id")), "qid")
    return pairs.where(fl.as_of(F.col("doc_id"), F.col("max_id"))).select("qid", "doc_id")


@query("drop_retweets", fx.sql("SELECT id FROM statuses WHERE retweeted_status_id IS NULL", "statuses"))
def drop_retweets(spark, sf):
    return fl.drop_retweets(fx.statuses(spark, sf)).select("id")


@query("has_place", fx.sql("SELECT id, place FROM statuses WHERE place IS NOT NULL", "statuses"))
def has_place(spark, sf):
    return fl.has_place(fx.statuses(spark, sf)).select("id", "place")


@query("field_projection", fx.sql("SELECT id, followers_count, friends_count, in_reply_to_status_id FROM statuses", "statuses"))
def field_projection(spark, sf):
    return fx.statuses(spark, sf).select("id", "followers_count", "friends_count", "in_reply_to_status_id")


_OPTIONAL = """CASE WHEN in_reply_to_status_id > 0 THEN in_reply_to_status_id END AS in_reply_to_status_id, CASE WHEN in_reply_to_status_id > 0 THEN in_reply_to_user_id END AS in_reply_to_user_id,
  CASE WHEN retweeted_status_id > 0 THEN retweeted_status_id END AS retweeted_status_id, CASE WHEN retweeted_status_id > 0 THEN retweet_count END AS retweet_count"""
_OPTIONAL_COLUMNS = ["id", "lang", "in_reply_to_status_id", "in_reply_to_user_id", "retweeted_status_id", "retweet_count"]


@query("to_index_rows", fx.sql(f"SELECT id, nullif(lang, 'unknown') AS lang, {_OPTIONAL} FROM statuses", "statuses"))
def to_index_rows(spark, sf):
    return fl.to_index_rows(fx.statuses(spark, sf)).select(*_OPTIONAL_COLUMNS)


@query(
    "index_statuses",
    fx.sql(
        f"""SELECT id, lang, {_OPTIONAL} FROM statuses WHERE id <= (SELECT max(doc_id) - 40 FROM labels) AND lang = 'en'
        AND (place IS NOT NULL OR longitude IS NOT NULL) AND id NOT IN (SELECT id FROM deletes)""",
        "statuses", "deletes",
    ),
)
def index_statuses(spark, sf):
    newest = fx.table(spark, sf, "labels").agg(F.max("doc_id")).first()[0]
    return fl.index_statuses(fx.statuses(spark, sf), fx.deletes(spark, sf), newest - 40, geo_only=True).select(*_OPTIONAL_COLUMNS)


@query("dump_ids", "SELECT doc_id::VARCHAR AS value FROM documents")
def dump_ids(spark, sf):
    path = fresh_path(spark, "ids")
    out.write_ids(fl.dump_ids(fx.corpus(spark, sf), "doc_id"), path)
    return spark.read.text(path)


@query("drop_deleted", fx.sql("SELECT id FROM statuses WHERE id NOT IN (SELECT id FROM deletes)", "statuses", "deletes"))
def drop_deleted(spark, sf):
    return fl.drop_deleted(fx.statuses(spark, sf), fx.deletes(spark, sf)).select("id")


@query("minus_ids", fx.sql("SELECT id FROM statuses EXCEPT SELECT id FROM deletes", "statuses", "deletes"))
def minus_ids(spark, sf):
    return fl.minus_ids(fx.statuses(spark, sf), fx.deletes(spark, sf))


@query(
    "upsert",
    fx.sql(
        """SELECT id, CASE WHEN id IN (SELECT doc_id FROM labels) THEN 'new ' || place ELSE place END AS place, lang FROM statuses""",
        "statuses",
    ),
)
def upsert(spark, sf):
    base = fx.statuses(spark, sf).select("id", "place", "lang")
    labelled = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("id")).distinct()
    changed = base.join(labelled, "id", "left_semi").withColumn("place", F.concat(F.lit("new "), "place")).withColumn("version", F.lit(2))
    older = changed.withColumns({"place": F.lit("old"), "version": F.lit(1)})
    return po.upsert(base, changed.unionByName(older), version="version").drop("version")


@query("in_cohort", fx.sql("SELECT id, user_id FROM statuses WHERE user_id IN (SELECT user_id FROM cohort)", "statuses", "cohort"))
def in_cohort(spark, sf):
    return jn.in_cohort(fx.statuses(spark, sf), fx.cohort(spark, sf)).select("id", "user_id")


@query("assign_city", fx.sql("SELECT id, city_no, city FROM city_hits", "city_hits"))
def assign_city(spark, sf):
    return geo.assign_city(fx.statuses(spark, sf), fx.cities(spark, sf)).select("id", "city_no", "city")


_CITY_ROWS = ", ".join(f"({i}, '{name}', {[*aliases, name]}, {lon}, {lat})" for i, (name, aliases, lon, lat) in enumerate(geo.CITIES))


@query(
    "city_table_hits",
    fx.sql(
        f"""SELECT s.id, c.city_no, c.name AS city FROM (SELECT id, longitude + lon AS x, latitude + lat AS y,
          CASE WHEN id % 4 = 0 THEN names[1] ELSE place END AS place FROM statuses JOIN cities ON id % {len(geo.CITIES)} = city_no) s
        JOIN cities c ON (x BETWEEN lon - {geo.BOX} AND lon + {geo.BOX} AND y BETWEEN lat - {geo.BOX} AND lat + {geo.BOX}) OR list_contains(names, s.place)""",
        "statuses",
    ).replace("WITH ", f"WITH cities AS (SELECT * FROM (VALUES {_CITY_ROWS}) t(city_no, name, names, lon, lat)), ", 1),
)
def city_table_hits(spark, sf):
    """The fixed city table against statuses moved to its cities, each by its own offset; every fourth names its city."""
    statuses, cities = fx.statuses(spark, sf), geo.city_table(spark)
    near = cities.select("city_no", "lon", "lat", F.concat("aliases", F.array("name"))[0].alias("called"))
    moved = statuses.join(F.broadcast(near), F.col("id") % len(geo.CITIES) == F.col("city_no"))
    moved = moved.select("id", (F.col("longitude") + F.col("lon")).alias("longitude"), (F.col("latitude") + F.col("lat")).alias("latitude"), F.when(F.col("id") % 4 == 0, F.col("called")).otherwise(F.col("place")).alias("place"))
    return geo.assign_city(moved, cities).select("id", "city_no", "city")


@query("city_counts", fx.sql("SELECT c.city_no, c.name AS city, count(h.id) AS n FROM cities c LEFT JOIN city_hits h USING (city_no) GROUP BY ALL", "city_hits"))
def city_counts(spark, sf):
    return geo.city_counts(fx.statuses(spark, sf), fx.cities(spark, sf))


@query(
    "first_per_user",
    fx.sql("SELECT user_id, id, city_no FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY city_no, id) AS rn FROM city_hits) WHERE rn = 1", "city_hits"),
)
def first_per_user(spark, sf):
    return geo.first_per_user(_hits(spark, sf).select("user_id", "id", "city_no"))


@query(
    "user_post_frequency",
    fx.sql(f"SELECT user_id, arg_max(statuses_count, id)::INT AS statuses_count, count(*) AS n_posts FROM statuses WHERE {_RELATED} GROUP BY user_id", "statuses"),
)
def user_post_frequency(spark, sf):
    return geo.user_post_frequency(fx.statuses(spark, sf), **CITY)


@query(
    "entries_by_value",
    fx.sql(
        """SELECT lang, user_id, n_posts, row_number() OVER (PARTITION BY lang ORDER BY n_posts DESC, user_id) AS rank
        FROM (SELECT lang, user_id, count(*) AS n_posts FROM statuses GROUP BY lang, user_id)""",
        "statuses",
    ),
)
def entries_by_value(spark, sf):
    """Users of each language by their number of posts."""
    counts = fx.statuses(spark, sf).groupBy("lang", "user_id").agg(F.count(F.lit(1)).alias("n_posts"))
    return geo.entries_by_value(counts, "user_id", "n_posts", "lang")


_PIECES = """SELECT user_id, n // 5 AS piece, count(*) AS n_texts, string_agg(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), ' ' ORDER BY id) AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id) - 1 AS n FROM timelines) GROUP BY ALL"""


@query("user_timelines", fx.sql(_PIECES, "timelines"))
def user_timelines(spark, sf):
    return geo.user_timelines(fx.timelines(spark, sf), piece_rows=5)


@query("with_timeline", fx.sql(f"SELECT s.id, user_id, piece, p.text AS timeline FROM statuses s JOIN ({_PIECES}) p USING (user_id)", "statuses", "timelines"))
def with_timeline(spark, sf):
    pieces = geo.user_timelines(fx.timelines(spark, sf), piece_rows=5)
    return jn.with_timeline(fx.statuses(spark, sf).select("id", "user_id"), pieces).select("id", "user_id", "piece", "timeline")


@query(
    "cohort_background",
    fx.sql(f"SELECT user_id, piece, n_texts, text FROM ({_PIECES}) WHERE user_id IN (SELECT user_id FROM city_hits) AND user_id IN (SELECT user_id FROM cohort)", "city_hits", "cohort", "timelines"),
)
def cohort_background(spark, sf):
    pieces = geo.user_timelines(fx.timelines(spark, sf), piece_rows=5)
    return geo.background(_hits(spark, sf), fx.cohort(spark, sf), pieces)


_TLT = f"SELECT user_id, term, count(*) AS tf FROM (SELECT user_id, unnest({_TEXT_TOKENS}) AS term FROM timelines) GROUP BY ALL"


@query("timeline_terms", fx.sql(_TLT, "timelines"))
def timeline_terms(spark, sf):
    return geo.timeline_terms(fx.timelines(spark, sf))


@query("background_terms", fx.sql(f"SELECT s.id, t.term, t.tf FROM statuses s JOIN ({_TLT}) t USING (user_id)", "statuses", "timelines"))
def background_terms(spark, sf):
    return jn.background_terms(fx.statuses(spark, sf), geo.timeline_terms(fx.timelines(spark, sf)))


def _hits(spark, sf):
    return geo.assign_city(fx.statuses(spark, sf), fx.cities(spark, sf))


_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY city_no, id) AS rn FROM city_hits) WHERE rn = 1 AND user_id IN (SELECT user_id FROM cohort)"
_FIELDS = f"""SELECT id, 'text:' || term AS term, count(*) AS tf FROM (SELECT id, unnest({_TEXT_TOKENS}) AS term FROM first) GROUP BY ALL
  UNION ALL SELECT id, 'user_description:' || term, count(*) FROM (SELECT id, unnest({fx.TOKENS.format('user_description')}) AS term FROM first) GROUP BY ALL
  UNION ALL SELECT id, 'user_url:' || regexp_replace(regexp_extract(user_url, '^[a-z]+://([^/?#:]+)', 1), '^www\\.', ''), 1 FROM first WHERE user_url IS NOT NULL
  UNION ALL SELECT id, 'user_location:' || user_location, 1 FROM first"""
_COHORT_SQL = fx.sql("", "city_hits", "cohort", "timelines", "terms", "stats").rstrip() + f""", first AS MATERIALIZED ({_FIRST}), ft AS MATERIALIZED ({_FIELDS}),
dict AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, count(*) AS df FROM ft GROUP BY term) """


def _first_hits(spark, sf):
    """First hit of each cohort user, one row per user."""
    return jn.in_cohort(geo.first_per_user(_hits(spark, sf)), fx.cohort(spark, sf))


@query("class_term_freq", fx.sql(
    """SELECT p.term, sum(CASE WHEN city_no = t.target THEN tf ELSE 0 END)::BIGINT AS tf_target, sum(CASE WHEN city_no = t.target THEN 0 ELSE tf END)::BIGINT AS tf_rest
    FROM city_hits h JOIN postings p ON p.doc_id = h.id, (SELECT max(city_no) AS target FROM cities) t GROUP BY p.term""", "city_hits", "postings"))
def class_term_freq(spark, sf):
    target = fx.cities(spark, sf).agg(F.max("city_no")).first()[0]
    terms = po.build_postings(fx.statuses(spark, sf), "id", positions=False).withColumnRenamed("doc_id", "id")
    return geo.class_term_freq(_hits(spark, sf), terms, target)


@query("cohort_vectors", _COHORT_SQL + "SELECT id, term, tf::INT AS tf FROM ft")
def cohort_vectors(spark, sf):
    return geo.cohort_vectors(_first_hits(spark, sf))


@query("cohort_dictionary", _COHORT_SQL + "SELECT term, term_id, df FROM dict")
def cohort_dictionary(spark, sf):
    return geo.dictionary(geo.cohort_vectors(_first_hits(spark, sf)))


@query("tf_vectors", _COHORT_SQL + "SELECT id, string_agg(term_id || ':' || tf, ' ' ORDER BY term_id) AS vec FROM ft JOIN dict USING (term) GROUP BY id")
def tf_vectors(spark, sf):
    terms = materialize(geo.cohort_vectors(_first_hits(spark, sf)), "terms")
    return geo.tf_vectors(terms, geo.dictionary(terms))


@query("binary_vectors", _COHORT_SQL + "SELECT id, string_agg(term_id || ':1', ' ' ORDER BY term_id) AS vec FROM ft JOIN dict USING (term) GROUP BY id")
def binary_vectors(spark, sf):
    terms = materialize(geo.cohort_vectors(_first_hits(spark, sf)), "terms")
    return geo.binary_vectors(terms, geo.dictionary(terms))


_LABELLED = _COHORT_SQL + """SELECT id, city, user_id, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS text, vec FROM first
JOIN (SELECT id, string_agg(term_id || ':' || tf, ' ' ORDER BY term_id) AS vec FROM ft JOIN dict USING (term) GROUP BY id) USING (id)"""


@query("labelled_vectors", _LABELLED)
def labelled_vectors(spark, sf):
    hits = materialize(_first_hits(spark, sf), "hits")
    terms = geo.cohort_vectors(hits)
    return geo.labelled_vectors(hits, geo.tf_vectors(terms, geo.dictionary(terms)))


@query("data_set_files", _LABELLED)
def data_set_files(spark, sf):
    """The labelled data set written as tables and lines, then read back."""
    hits = materialize(_first_hits(spark, sf), "hits")
    terms = materialize(geo.cohort_vectors(hits), "terms")
    words = geo.dictionary(terms)
    path = fresh_path(spark, "dataset")
    out.write_dataset(geo.labelled_vectors(hits, geo.tf_vectors(terms, words)), words, path, as_text=True)
    return spark.read.parquet(f"{path}/rows")


@query(
    "expand_from_timeline",
    _COHORT_SQL + f""", tl AS MATERIALIZED ({_TLT}),
    wt AS MATERIALIZED (SELECT user_id, term, round(ln(tf * (SELECT n_docs FROM stats) / (coalesce(ctf, 0) + 1)), 9) AS weight FROM tl LEFT JOIN terms USING (term)
      WHERE NOT contains(term, '@') AND 'text:' || term IN (SELECT term FROM dict)),
    rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, term) AS place FROM wt),
    sz AS (SELECT id, count(*) AS n_terms FROM ft WHERE term LIKE 'text:%' OR term LIKE 'user\\_description:%' ESCAPE '\\' GROUP BY id)
    SELECT f.id, 'text:' || r.term AS term, 1.0::DOUBLE AS value FROM first f LEFT JOIN sz USING (id) JOIN rk r USING (user_id)
    WHERE r.place <= greatest(coalesce(n_terms, 0), 10) AND NOT EXISTS (SELECT 1 FROM ft x WHERE x.id = f.id AND x.term = 'text:' || r.term)""",
)
def expand_from_timeline(spark, sf):
    hits = materialize(_first_hits(spark, sf), "hits")
    index = fx.index(spark, sf)
    return geo.expand_from_timeline(hits, geo.cohort_vectors(hits), geo.timeline_terms(fx.timelines(spark, sf)), index.terms, index.stat("n_docs"))


@query(
    "geo_term_listing",
    fx.sql("SELECT id, term, tf::INT AS tf FROM statuses JOIN postings ON doc_id = id WHERE longitude BETWEEN -0.1 AND 0.1 AND latitude BETWEEN -0.1 AND 0.1", "statuses", "postings"),
)
def geo_term_listing(spark, sf):
    return geo.geo_term_listing(fx.statuses(spark, sf), 0.0, 0.0, 0.1)


_EMBED = """SELECT doc_id, {parts} FROM postings JOIN vectors USING (term) GROUP BY doc_id"""
_DIMS = 64


def _embedded(spark, sf):
    index = fx.index(spark, sf)
    vectors = fx.ranked_vectors(spark, sf, index.terms)
    return index, geo.doc_embeddings(index.postings, vectors, _DIMS)


_SHOWN = tuple(range(1, 65))


@query(
    "doc_embeddings",
    fx.sql(_EMBED.format(parts=", ".join(f"round(sum(tf * embedding[{i}]::DOUBLE) / sum(tf), 6) AS e{i}" for i in _SHOWN)), "postings", "vectors"),
)
def doc_embeddings(spark, sf):
    return _embedded(spark, sf)[1].select("doc_id", *(F.round(F.element_at("embedding", i), 6).alias(f"e{i}") for i in _SHOWN))


@query("labelled_embeddings", fx.sql(
    f"""SELECT h.id, h.city, {', '.join(f'e{i}' for i in _SHOWN)} FROM city_hits h JOIN ({_EMBED.format(parts=", ".join(f"round(sum(tf * embedding[{i}]::DOUBLE) / sum(tf), 6) AS e{i}" for i in _SHOWN))})
    e ON e.doc_id = h.id""", "city_hits", "postings", "vectors"))
def labelled_embeddings(spark, sf):
    embedded = _embedded(spark, sf)[1].withColumnRenamed("doc_id", "id")
    rows = _hits(spark, sf).select("id", "city").join(embedded, "id")
    return rows.select("id", "city", *(F.round(F.element_at("embedding", i), 6).alias(f"e{i}") for i in _SHOWN))


@query("term_vectors", fx.sql(f"SELECT doc_id, term, tf::INT AS tf, {fx.WEIGHTED_SQL} AS weighted FROM postings JOIN vectors USING (term)", "postings", "vectors"))
def term_vectors(spark, sf):
    """The sum of place times value rests on every value of a vector."""
    index = fx.index(spark, sf)
    joined = jn.term_vectors(index.postings, fx.ranked_vectors(spark, sf, index.terms))
    return joined.select("doc_id", "term", "tf", fx.weighted("embedding").alias("weighted"))


@query("empty_documents", fx.sql("SELECT count(*) AS n_empty FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM postings JOIN vectors USING (term))", "postings", "vectors"))
def empty_documents(spark, sf):
    return geo.empty_count(fx.corpus(spark, sf), _embedded(spark, sf)[1])


@query(
    "reply_roots",
    "WITH RECURSIVE " + f"replies AS ({fx.CTE['replies'][1]})" + """,
    up AS (SELECT id, id AS root_id, 0 AS depth, id AS at FROM replies
      UNION ALL SELECT u.id, p.id, u.depth + 1, p.id FROM up u JOIN replies c ON c.id = u.at JOIN replies p ON p.id = c.in_reply_to_status_id)
    SELECT id, arg_max(root_id, depth) AS root_id, max(depth)::BIGINT AS depth FROM up GROUP BY id""",
)
def reply_roots(spark, sf):
    return jn.reply_roots(fx.replies(spark, sf))


@query(
    "reply_chain",
    "WITH RECURSIVE " + f"replies AS ({fx.CTE['replies'][1]})" + """,
    up AS (SELECT id AS start_id, id, 0 AS steps FROM replies
      UNION ALL SELECT u.start_id, p.id, u.steps + 1 FROM up u JOIN replies c ON c.id = u.id JOIN replies p ON p.id = c.in_reply_to_status_id)
    SELECT start_id, id, steps::INT AS steps FROM up""",
)
def reply_chain(spark, sf):
    replies = fx.replies(spark, sf)
    return jn.reply_chain(replies, replies.select("id"))
