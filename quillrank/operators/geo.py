"""City matching, user statistics and labelled vector data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold_newlines, tokens, url_domain
from ..sizing import lookup_join, split_hot_join
from .filters import city_related, in_box
from .joins import in_cohort
from .postings import Analyzer, build_postings, numbered

# The cities of the data sets, with other names, longitude and latitude.
CITIES = (
    ("Brooklyn, NY", ("Manhattan, NY",), -74.0063889, 40.7141667),
    ("Chicago, IL", (), -87.6500000, 41.8500000),
    ("Los Angeles, CA", (), -118.253842, 34.040667),
    ("Philadelphia, PA", (), -75.1641667, 39.9522222),
    ("Washington, DC", (), -77.0366667, 38.8950000),
    ("Houston, TX", (), -95.3630556, 29.7630556),
    ("Minneapolis, MN", (), -93.2636111, 44.9800000),
    ("Cincinnati, OH", (), -84.4569444, 39.1619444),
    ("Portland, ME", (), -70.2558333, 43.6613889),
    ("St Louis, MO", (), -90.197778, 38.627222),
    ("Cleveland, OH", (), -81.669722, 41.482222),
    ("Pittsburgh, PA", (), -79.976389, 40.439722),
)

#: Half width of the box around a city centre, in degrees.
BOX = 0.05


def city_table(spark: SparkSession) -> DataFrame:
    """``cities(city_no, name, aliases, lon, lat)``."""
    rows = [(i, name, list(aliases), lon, lat) for i, (name, aliases, lon, lat) in enumerate(CITIES)]
    return spark.createDataFrame(rows, "city_no INT, name STRING, aliases ARRAY<STRING>, lon DOUBLE, lat DOUBLE")


def _cell(lon: Column, lat: Column, width: float) -> Column:
    return F.concat_ws(":", F.lit("cell"), F.floor(lon / F.lit(width)), F.floor(lat / F.lit(width)))


def _place(name: Column) -> Column:
    return F.concat(F.lit("place:"), name)


def assign_city(df: DataFrame, cities: DataFrame, d: float = BOX) -> DataFrame:
    """Statuses with each city they match by box or by exact place name.

    The range condition becomes an equi join: a centre covers the nine grid cells around it and
    its names are keys too, a status has the key of its cell and of its place. A status that
    matches by box is not matched again by place, so there are no duplicates to remove. With a
    small city table this is a broadcast hash join; with a large one it shuffles on the keys
    and splits crowded cells.
    """
    width = 2 * d
    shifts = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]
    cells = F.array(*(_cell(F.col("lon") + F.lit(x * width), F.col("lat") + F.lit(y * width), width) for x, y in shifts))
    names = F.transform(F.array_distinct(F.concat(F.array("name"), F.col("aliases"))), lambda n: _place(n))
    keyed = cities.select(
        "city_no", F.col("name").alias("city"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"),
        F.explode(F.concat(F.array_distinct(cells), names)).alias("_key"),
    )
    own = F.array_compact(F.array(_cell_of("longitude", "latitude", width), _place(F.col("place"))))
    statuses = df.withColumn("_key", F.explode(own))
    met = lookup_join(statuses, keyed, "_key", spread_on="id")
    boxed = F.coalesce(in_box(F.col("longitude"), F.col("latitude"), F.col("_lon"), F.col("_lat"), d), F.lit(False))
    by_place = F.startswith(F.col("_key"), F.lit("place:"))
    return met.where(by_place != boxed).drop("_key", "_lon", "_lat")


def _cell_of(lon: str, lat: str, width: float) -> Column:
    both = F.col(lon).isNotNull() & F.col(lat).isNotNull()
    return F.when(both, _cell(F.col(lon), F.col(lat), width))


def city_counts(df: DataFrame, cities: DataFrame, d: float = BOX) -> DataFrame:
    """``(city_no, city, n)``; cities without hits have 0."""
    counts = assign_city(df, cities, d).groupBy("city_no").agg(F.count(F.lit(1)).alias("n"))
    return cities.select("city_no", F.col("name").alias("city")).join(counts, "city_no", "left").fillna(0, ["n"])


def first_per_user(hits: DataFrame) -> DataFrame:
    """The first hit of each user in city order, then id order.

    A minimum per user is formed before the shuffle, so a user with very many hits is one row
    per task.
    """
    kept = [c for c in hits.columns if c != "user_id"]
    first = hits.groupBy("user_id").agg(F.min_by(F.struct(*kept), F.struct("city_no", "id")).alias("_first"))
    return first.select("user_id", "_first.*").select(*hits.columns)


def user_post_frequency(df: DataFrame, name: str, short_name: str, lon: float, lat: float, d: float = BOX) -> DataFrame:
    """``(user_id, statuses_count, n_posts)`` over city-related statuses, with the latest status count."""
    related = city_related(df, name, short_name, lon, lat, d)
    return related.groupBy("user_id").agg(
        F.max_by("statuses_count", F.struct("epoch", "id")).alias("statuses_count"), F.count(F.lit(1)).alias("n_posts")
    )


def entries_by_value(counts: DataFrame, key: str, value: str, *group: str) -> DataFrame:
    """Entries by falling value, ties by key; with ``group``, a ``rank`` within each group instead of one order."""
    order = [F.desc(value), F.asc(key)]
    if not group:
        return counts.orderBy(*order)
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def user_timelines(df: DataFrame, piece_rows: int = 1_000) -> DataFrame:
    """``(user_id, piece, n_texts, text)``: texts of a user joined in id order, line ends folded.

    A timeline comes in pieces of at most ``piece_rows`` texts, numbered from 0 within the user and to be
    read in that order. A user who wrote a large share of all statuses would not fit into one row or one task.
    """
    ordered = numbered(df.select("user_id", "id", fold_newlines("text").alias("text")), "user_id", "id")
    first = ordered.groupBy("user_id").agg(F.min("n").alias("_first"))
    ordered = lookup_join(ordered, first, "user_id", spread_on="id")
    pieces = ordered.groupBy("user_id", F.floor((F.col("n") - F.col("_first")) / F.lit(piece_rows)).alias("piece")).agg(
        F.count(F.lit(1)).alias("n_texts"), F.sort_array(F.collect_list(F.struct("id", "text"))).alias("_texts")
    )
    return pieces.select("user_id", "piece", "n_texts", F.array_join(F.col("_texts.text"), " ").alias("text"))


def timeline_terms(timelines: DataFrame, text: str = "text", analyzer: Analyzer = tokens) -> DataFrame:
    """``(user_id, term, tf)`` over all texts of a user; needs no joined timeline."""
    words = timelines.select("user_id", F.explode(analyzer(F.col(text))).alias("term"))
    return words.groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def background(hits: DataFrame, cohort: DataFrame, timelines: DataFrame) -> DataFrame:
    """Timeline pieces of the cohort users that have hits, once per user."""
    users = in_cohort(hits, cohort).select("user_id").distinct()
    return lookup_join(timelines, users, "user_id", "left_semi", spread_on="piece")


def class_term_freq(hits: DataFrame, terms: DataFrame, target: int) -> DataFrame:
    """``(term, tf_target, tf_rest)`` of labelled hits; ``terms(id, term, tf)`` are their terms."""
    labelled = lookup_join(terms, hits.select("id", "city_no"), "id")
    hit = F.col("city_no") == target
    return labelled.groupBy("term").agg(
        F.sum(F.when(hit, F.col("tf")).otherwise(0)).alias("tf_target"), F.sum(F.when(hit, 0).otherwise(F.col("tf"))).alias("tf_rest")
    )


def _field_terms(hits: DataFrame, column: str, analyzer: Analyzer) -> DataFrame:
    postings = build_postings(hits, "id", column, positions=False, analyzer=analyzer)
    return postings.select(F.col("doc_id").alias("id"), F.concat(F.lit(f"{column}:"), F.col("term")).alias("term"), "tf")


def cohort_vectors(hits: DataFrame, analyzer: Analyzer = tokens) -> DataFrame:
    """``(id, term, tf)`` with field names before the terms.

    Terms of text and user description count; the hosts of the user's and the outgoing links and
    the user's location are features of their own with value 1.
    """
    parts = [_field_terms(hits, c, analyzer) for c in ("text", "user_description") if c in hits.columns]
    one = F.lit(1).alias("tf")
    if "user_url" in hits.columns:
        host = url_domain("user_url")
        parts.append(hits.select("id", F.concat(F.lit("user_url:"), host).alias("term"), one).where("term IS NOT NULL"))
    if "urls" in hits.columns:
        links = hits.select("id", F.explode("urls").alias("url"))
        host = url_domain("url")
        linked = links.select("id", F.concat(F.lit("tweetOutlinkDomain:"), host).alias("term")).where("term IS NOT NULL")
        parts.append(linked.distinct().select("id", "term", one))
    if "user_location" in hits.columns:
        place = fold_newlines("user_location")
        parts.append(hits.select("id", F.concat(F.lit("user_location:"), place).alias("term"), one).where("term IS NOT NULL"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dictionary(terms: DataFrame) -> DataFrame:
    """``(term, term_id, df)`` over ``terms(id, term)``, with dense ids in term order."""
    counted = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return numbered(counted, "term").select("term", F.col("n").alias("term_id"), "df")


def _lines(weighted: DataFrame) -> DataFrame:
    vec = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("term_id", "value"))), lambda x: F.concat_ws(":", x["term_id"], x["value"])), " ")
    return weighted.groupBy("id").agg(vec.alias("vec"))


def tf_vectors(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(id, vec)`` with ``term_id:tf`` in id order; a row has no more entries than its text has terms."""
    known = lookup_join(terms, dictionary.select("term", "term_id"), "term", spread_on="id")
    return _lines(known.withColumn("value", F.col("tf").cast("string")))


def binary_vectors(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(id, vec)`` with ``term_id:1``."""
    return tf_vectors(terms.withColumn("tf", F.lit(1)), dictionary)


def labelled_vectors(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(id, city, user_id, text, vec)``: label, raw text and vector of a hit in one row."""
    return hits.select("id", "city", "user_id", fold_newlines("text").alias("text")).join(vectors, "id")


def expand_from_timeline(
    hits: DataFrame, terms: DataFrame, timeline_terms: DataFrame, stats: DataFrame, n_docs: Column | int, discount: float = 1.0, floor: int = 10
) -> DataFrame:
    """``(id, term, value)``: terms of the user's timeline added to the vector of a hit.

    ``terms(id, term)`` are the prefixed terms of the hits; ``stats(term, ctf)`` counts the
    collection. The best ``max(terms of the hit, floor)`` known timeline terms by
    ``ln(tf * N / (ctf + 1))`` are kept, those already present are left out.
    """
    known = terms.where(F.startswith("term", F.lit("text:"))).select(F.substring("term", 6, 1 << 30).alias("term")).distinct()
    weighed = lookup_join(timeline_terms.where(~F.contains("term", F.lit("@"))), known, "term", "left_semi", spread_on="user_id")
    weighed = lookup_join(weighed, stats.select("term", "ctf"), "term", "left", spread_on="user_id").select(
        "user_id", "term", F.round(F.log(F.col("tf") * n_docs / (F.coalesce("ctf", F.lit(0)) + 1)), 9).alias("weight")
    )
    # Bounded by the vocabulary: a user has one row per distinct term however much they wrote.
    ranked = weighed.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("weight"), "term")))
    sizes = terms.where(F.startswith("term", F.lit("text:")) | F.startswith("term", F.lit("user_description:"))).groupBy("id").agg(F.count(F.lit(1)).alias("n_terms"))
    sized = hits.select("id", "user_id").join(sizes, "id", "left").fillna(0, ["n_terms"])
    added = split_hot_join(sized, ranked, ["user_id"], "inner", "id").where(F.col("place") <= F.greatest("n_terms", F.lit(floor)))
    added = added.select("id", F.concat(F.lit("text:"), F.col("term")).alias("term"))
    return added.join(terms.select("id", "term"), ["id", "term"], "left_anti").withColumn("value", F.lit(float(discount)))


def geo_term_listing(df: DataFrame, lon: float, lat: float, d: float = BOX, analyzer: Analyzer = tokens) -> DataFrame:
    """``(id, term, tf)`` of the statuses in the box around one centre."""
    near = df.where(in_box(F.col("longitude"), F.col("latitude"), F.lit(lon), F.lit(lat), d))
    return build_postings(near, "id", "text", positions=False, analyzer=analyzer).select(F.col("doc_id").alias("id"), "term", "tf")


def doc_embeddings(postings: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """``(doc_id, embedding)``: mean of the term vectors weighted by tf; unknown terms are ignored.

    One sum per dimension in a single aggregate, combined before the shuffle; the vectors are
    not exploded into a row per dimension.
    """
    from .joins import term_vectors

    joined = term_vectors(postings.select("doc_id", "term", "tf"), vectors)
    sums = [F.sum(F.col("tf") * F.get("embedding", F.lit(i)).cast("double")).alias(f"_s{i}") for i in range(dimensions)]
    summed = joined.groupBy("doc_id").agg(F.sum("tf").alias("_n"), *sums)
    mean = F.array(*(F.col(f"_s{i}") / F.col("_n") for i in range(dimensions)))
    return summed.select("doc_id", mean.alias("embedding"))


def empty_count(docs: DataFrame, embedded: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: documents that got no vector."""
    return docs.select(key).join(embedded.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_empty"))
