"""Streaming jobs over the test tables, drained to the end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as fl
from ..operators import segments as sg
from ..session import fresh_path
from ..sources import statuses as st
from ..streaming import counters as ct
from ..streaming import live
from . import fixtures as fx
from .registry import query
from .source_queries import raw_fields, status_lines, write_lines, write_statuses
from .status_queries import CITY, _RELATED


def _drain(started) -> None:
    started.awaitTermination()


def _event_stream(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    return fx.messages(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def _status_stream(spark, sf, **writer):
    """Status messages as files of JSON lines, a few files per micro-batch."""
    lines = st.stream_messages(spark, write_statuses(spark, sf, **writer), files_per_trigger=4)
    return lines, st.split_messages(lines)


@query(
    "stream_messages",
    fx.sql("SELECT id, user_id, text, 'add' AS op FROM statuses UNION ALL SELECT id, NULL, NULL, 'delete' FROM deletes", "statuses", "deletes"),
)
def stream_messages(spark, sf):
    """Statuses and delete messages, as lines of the same files."""
    path, source = fresh_path(spark, "messages"), fresh_path(spark, "lines")
    deletes = fx.deletes(spark, sf).select(F.to_json(F.struct(F.struct(F.struct("id").alias("status")).alias("delete"))).alias("value"))
    write_lines(status_lines(fx.statuses(spark, sf)).unionByName(deletes), source)
    messages = st.split_messages(st.stream_messages(spark, source, files_per_trigger=4))
    shown = messages.select("id", "user_id", "text", "op")
    _drain(
        shown.writeStream.format("parquet").option("path", path).option("checkpointLocation", fresh_path(spark, "cp")).trigger(availableNow=True).start()
    )
    return spark.read.schema(shown.schema).parquet(path)


@query("ingest_with_deletes", fx.sql("SELECT id, seq, user_id, event_type, value FROM live", "live"))
def ingest_with_deletes(spark, sf):
    path = fresh_path(spark, "live")
    _drain(live.ingest(_event_stream(spark, sf), path, fresh_path(spark, "cp"), order="seq"))
    return live.live_table(spark, path).select("id", "seq", "user_id", "event_type", "value")


@query("compacted_live_table", fx.sql("SELECT id, seq, user_id, event_type, value FROM live", "live"))
def compacted_live_table(spark, sf):
    path = fresh_path(spark, "live")
    _drain(live.ingest(_event_stream(spark, sf), path, fresh_path(spark, "cp"), order="seq"))
    live.compact_live(spark, path)
    return live.live_table(spark, path).select("id", "seq", "user_id", "event_type", "value")


@query(
    "apply_deletes",
    fx.sql("SELECT id, event_type FROM live", "live"),
)
def apply_deletes(spark, sf):
    """Views as the base, the whole message log on top."""
    log = fx.messages(fx.table(spark, sf, "events"))
    base = log.where("op = 'add' AND event_type = 'view'").select("id", "event_type")
    return live.apply_deletes(base, log.select("id", "op", "event_type", "seq"), "seq").select("id", "event_type")


@query(
    "live_search",
    fx.sql(
        """SELECT doc_id, score FROM (SELECT doc_id, round(sum(qtf * sqrt(tf) * (1 + ln(n_docs / (df + 1))) * (1 + ln(n_docs / (df + 1)))) * count(*) / max(qlen), 6) AS score
        FROM matches JOIN qlen USING (qid), stats WHERE qid = '0' GROUP BY doc_id) ORDER BY score DESC, doc_id LIMIT 20""",
        "matches", "qlen", "stats",
    ),
)
def live_search(spark, sf):
    """Statuses are indexed as they arrive, a segment a batch, and searched there."""
    path = fresh_path(spark, "live")
    sg.create(spark, path, positions=False, term_buckets=8, doc_buckets=8)
    _, messages = _status_stream(spark, sf, compression="gzip")
    _drain(live.index_stream(messages, path, fresh_path(spark, "cp")))
    text = fx.topics(spark, sf).where("qid = '0'").first()["query"]
    return live.live_search(spark, path, text)


@query("archive_raw", fx.sql("SELECT id, text, screen_name FROM statuses", "statuses"))
def archive_raw(spark, sf):
    path = fresh_path(spark, "archive")
    lines, _ = _status_stream(spark, sf)
    _drain(live.archive_raw(lines, path, fresh_path(spark, "cp")))
    return raw_fields(spark.read.text(path))


@query(
    "stream_counters",
    fx.sql(
        """SELECT (SELECT count(*) FROM statuses) AS n_indexed, (SELECT count(*) FROM statuses WHERE longitude IS NOT NULL AND latitude IS NOT NULL) AS n_geo,
        (SELECT count(*) FROM statuses s JOIN cities c ON abs(s.longitude - c.lon) < 0.05 AND abs(s.latitude - c.lat) < 0.05) AS n_recognised""",
        "statuses", "cities",
    ),
)
def stream_counters(spark, sf):
    path = fresh_path(spark, "counters")
    _, messages = _status_stream(spark, sf)
    _drain(ct.stream_counters(messages.where("op = 'add'"), fx.cities(spark, sf), path, fresh_path(spark, "cp")))
    return spark.read.parquet(path)


@query(
    "stream_user_frequency",
    fx.sql(f"SELECT user_id, arg_max(statuses_count, id)::INT AS statuses_count, count(*) AS n_posts FROM statuses WHERE {_RELATED} GROUP BY user_id", "statuses"),
)
def stream_user_frequency(spark, sf):
    path = fresh_path(spark, "frequency")
    _, messages = _status_stream(spark, sf)
    _drain(ct.stream_user_frequency(messages.where("op = 'add'"), path, fresh_path(spark, "cp"), **CITY))
    return ct.user_frequency(spark, path)


@query("stream_city_match", fx.sql("SELECT id, city_no, city FROM city_hits", "city_hits"))
def stream_city_match(spark, sf):
    path = fresh_path(spark, "matches")
    _, messages = _status_stream(spark, sf)
    _drain(ct.stream_city_match(messages.where("op = 'add'"), fx.cities(spark, sf), path, fresh_path(spark, "cp")))
    return spark.read.parquet(path).select("id", "city_no", "city")


@query("stream_filter", fx.sql("SELECT id, place FROM statuses WHERE lang = 'en' AND (place IS NOT NULL OR longitude IS NOT NULL)", "statuses"))
def stream_filter(spark, sf):
    """The batch filters work on the stream as they are."""
    path = fresh_path(spark, "filtered")
    _, messages = _status_stream(spark, sf)
    shown = fl.english_geo(messages).select("id", "place")
    _drain(
        shown.writeStream.format("parquet").option("path", path).option("checkpointLocation", fresh_path(spark, "cp")).trigger(availableNow=True).start()
    )
    return spark.read.schema(shown.schema).parquet(path)
