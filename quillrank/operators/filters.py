"""Filters and projections over records and statuses. All are pushed to the scan where it can."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sizing import lookup_join


def only_responses(records: DataFrame) -> DataFrame:
    return records.where(F.col("type") == "response")


def drop_empty(docs: DataFrame, text: str = "text", counted: Observation | None = None) -> DataFrame:
    """Documents with text other than blanks and control characters.

    ``counted`` receives ``n_empty`` and ``n_rows`` when the job has run.
    """
    empty = F.coalesce(~F.col(text).rlike(r"[^\x00-\x20]"), F.lit(True))
    if counted is not None:
        docs = docs.observe(counted, F.count(F.lit(1)).alias("n_rows"), F.count_if(empty).alias("n_empty"))
    return docs.where(~empty)


def cap_id(df: DataFrame, max_id: int, id_col: str = "id") -> DataFrame:
    return df.where(F.col(id_col) <= F.lit(max_id))


def english_geo(df: DataFrame) -> DataFrame:
    """English statuses with a place or with both coordinates."""
    located = F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    return df.where((F.col("lang") == "en") & (F.col("place").isNotNull() | located))


def in_box(lon: Column, lat: Column, centre_lon, centre_lat, d: float = 0.05) -> Column:
    """Inclusive box around a centre."""
    return lon.between(centre_lon - d, centre_lon + d) & lat.between(centre_lat - d, centre_lat + d)


def within_area(lon: Column, lat: Column, centre_lon, centre_lat, d: float = 0.05) -> Column:
    """Strict box around a centre."""
    return (F.abs(lon - centre_lon) < d) & (F.abs(lat - centre_lat) < d)


def place_is(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.where(F.col("place").isin(*names))


def city_related(df: DataFrame, name: str, short_name: str, lon: float, lat: float, d: float = 0.05) -> DataFrame:
    """Strict box, place or user location with the full name, or text with the short name."""
    signs = [
        within_area(F.col("longitude"), F.col("latitude"), F.lit(lon), F.lit(lat), d),
        F.contains(F.col("place"), F.lit(name)),
        F.contains(F.col("user_location"), F.lit(name)),
        F.contains(F.col("text"), F.lit(short_name)),
    ]
    found = F.lit(False)
    for sign in signs:
        found = found | F.coalesce(sign, F.lit(False))
    return df.where(found)


def as_of(doc_id: Column, max_id: Column) -> Column:
    """Ids a query may see: from 0 to the id at query time; no bound when the query has none."""
    return max_id.isNull() | doc_id.between(F.lit(0), max_id)


def drop_retweets(df: DataFrame) -> DataFrame:
    return df.where(F.col("retweeted_status_id").isNull())


def expansion_terms(postings: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """Terms fit for query expansion: two or more letters or digits and not on the stop list."""
    kept = postings.where((F.length("term") >= 2) & F.col("term").rlike("^[a-z0-9]+$"))
    return kept if stop is None else lookup_join(kept, stop.select("term"), "term", "left_anti", spread_on="doc_id")


def has_place(df: DataFrame) -> DataFrame:
    return df.where(F.col("place").isNotNull())


def drop_deleted(df: DataFrame, deletes: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is not on the delete list. Ids are unique in ``df``, so no key is hot."""
    return lookup_join(df, deletes.select(key), key, "left_anti")


def minus_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Distinct ids of ``df`` without those of ``ids``."""
    return df.select(key).exceptAll(ids.select(key).distinct())


def to_index_rows(df: DataFrame) -> DataFrame:
    """Optional fields only where they carry something: reply and retweet ids above 0, known language."""
    reply, retweet = F.col("in_reply_to_status_id") > 0, F.col("retweeted_status_id") > 0
    optional = {
        "lang": F.nullif(F.col("lang"), F.lit("unknown")),
        "in_reply_to_status_id": F.when(reply, F.col("in_reply_to_status_id")),
        "in_reply_to_user_id": F.when(reply, F.col("in_reply_to_user_id")),
        "retweeted_status_id": F.when(retweet, F.col("retweeted_status_id")),
        "retweeted_user_id": F.when(retweet, F.col("retweeted_user_id")),
        "retweet_count": F.when(retweet, F.col("retweet_count")),
    }
    return df.withColumns({name: value for name, value in optional.items() if name in df.columns})


def index_statuses(df: DataFrame, deletes: DataFrame | None = None, max_id: int | None = None, geo_only: bool = False) -> DataFrame:
    """Statuses to index: id cap, delete list, optional language and place filter, optional fields."""
    if max_id is not None:
        df = cap_id(df, max_id)
    if geo_only:
        df = english_geo(df)
    if deletes is not None:
        df = drop_deleted(df, deletes)
    return to_index_rows(df)


def dump_ids(df: DataFrame, column: str) -> DataFrame:
    """The id column of a table. A missing column, or a table without rows, is an error."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r} in {df.columns}")
    ids = df.select(column)
    if ids.isEmpty():
        raise ValueError("the table has no rows")
    return ids
