"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _status_json() -> T.StructType:
    user = T.StructType(
        [T.StructField(n, T.StringType()) for n in ("id_str", "screen_name", "location", "description", "url")]
        + [T.StructField(n, T.IntegerType()) for n in ("followers_count", "friends_count", "statuses_count")]
    )
    link = T.StructType([T.StructField("expanded_url", T.StringType())])
    original = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("user", T.StructType([T.StructField("id", T.LongType())])),
        ]
    )
    deleted = T.StructType([T.StructField("status", T.StructType([T.StructField("id", T.LongType())]))])
    return T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("created_at", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("in_reply_to_status_id", T.LongType()),
            T.StructField("in_reply_to_user_id", T.LongType()),
            T.StructField("retweet_count", T.StringType()),
            T.StructField("place", T.StructType([T.StructField("full_name", T.StringType())])),
            T.StructField(
                "coordinates", T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))])
            ),
            T.StructField("retweeted_status", original),
            T.StructField("entities", T.StructType([T.StructField("urls", T.ArrayType(link))])),
            T.StructField("user", user),
            T.StructField("delete", deleted),
        ]
    )


STATUS_JSON = _status_json()

STATUS_COLUMNS = [
    "id", "text", "screen_name", "user_id", "created_at", "epoch", "place",
    "in_reply_to_status_id", "in_reply_to_user_id", "retweeted_status_id", "retweeted_user_id",
    "retweet_count", "longitude", "latitude", "lang", "followers_count", "friends_count",
    "statuses_count", "user_location", "user_description", "user_url", "urls",
]

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
