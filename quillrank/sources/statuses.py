"""Status collections: JSON lines, TSV, raw lines and the live stream."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_count, to_epoch
from ..schemas import STATUS_COLUMNS, STATUS_JSON


def status_columns(messages: DataFrame) -> DataFrame:
    """Flat status columns of parsed JSON messages; missing values are NULL, unknown language is ``unknown``."""
    point = F.col("coordinates.coordinates")
    columns: dict[str, Column] = {
        "screen_name": F.col("user.screen_name"),
        "user_id": F.col("user.id_str"),
        "epoch": to_epoch("created_at"),
        "place": F.col("place.full_name"),
        "retweeted_status_id": F.col("retweeted_status.id"),
        "retweeted_user_id": F.col("retweeted_status.user.id"),
        "retweet_count": F.when(F.col("retweeted_status.id").isNotNull(), parse_count("retweet_count")),
        "longitude": F.get(point, F.lit(0)),
        "latitude": F.get(point, F.lit(1)),
        "lang": F.coalesce(F.col("lang"), F.lit("unknown")),
        "followers_count": F.col("user.followers_count"),
        "friends_count": F.col("user.friends_count"),
        "statuses_count": F.col("user.statuses_count"),
        "user_location": F.col("user.location"),
        "user_description": F.col("user.description"),
        "user_url": F.col("user.url"),
        "urls": F.col("entities.urls.expanded_url"),
    }
    kept = [c for c in ("arrival",) if c in messages.columns]
    return messages.select(*(columns.get(c, F.col(c)).alias(c) for c in STATUS_COLUMNS), *kept)


def read_raw(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """Unparsed lines, ``(value)``.

    With ``pattern``, the ``.gz`` files of the folder and one level below are read whose path
    contains one of the parts between colons; no such file is an error.
    """
    if pattern is None:
        return spark.read.text(path if isinstance(path, str) else list(path))
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").text(path)
    file = F.col("_metadata.file_path")
    below = F.element_at(F.split(file, re.escape(path.rstrip("/") + "/")), -1)
    wanted = F.lit(False)
    for part in pattern.split(":"):
        wanted = wanted | F.contains(file, F.lit(part))
    found = lines.where(wanted & (F.size(F.split(below, "/")) <= 2))
    if found.isEmpty():
        raise ValueError(f"no .gz file below {path} matches {pattern!r}")
    return found


def read_statuses(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """Statuses of JSON-lines files; broken lines and lines without id or text are dropped.

    ``path`` may be a list of files and folders. With ``pattern``, the ``.gz`` files of the folder
    and one level below are read whose path contains one of the parts between colons.
    """
    lines = read_raw(spark, path, pattern)
    return status_columns(parse_messages(lines)).where(F.col("id").isNotNull() & F.col("text").isNotNull())


def parse_messages(lines: DataFrame) -> DataFrame:
    """JSON text in ``value`` as nested message columns; broken lines give NULL columns."""
    kept = [c for c in lines.columns if c == "arrival"]
    return lines.select(F.from_json("value", STATUS_JSON, {"mode": "PERMISSIVE"}).alias("m"), *kept).select("m.*", *kept)


def read_statuses_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``(id, screen_name, created_at, epoch, text)``; lines of fewer than four columns are dropped."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 4)
    return parts.select(
        F.col("p")[0].try_cast("bigint").alias("id"),
        F.col("p")[1].alias("screen_name"),
        F.col("p")[2].alias("created_at"),
        to_epoch(F.col("p")[2]).alias("epoch"),
        F.array_join(F.slice("p", 4, F.size("p")), " ").alias("text"),
    ).where(F.col("id").isNotNull())


def stream_messages(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """Streaming ``(value, arrival)`` of raw JSON message lines.

    ``arrival`` orders the lines of different files: by the time a file was written, then by its name and the
    place in it. A batch reads many files, and not in that order.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    file = F.col("_metadata")
    return lines.select("value", F.struct(file["file_modification_time"].alias("at"), file["file_path"].alias("file"), file["file_block_start"].alias("block")).alias("arrival"))


def split_messages(lines: DataFrame) -> DataFrame:
    """Status columns plus ``op``: ``add`` for a status with text, ``delete`` for a delete message."""
    messages = parse_messages(lines)
    removed = F.col("delete.status.id")
    known = messages.where(F.col("text").isNotNull() | removed.isNotNull())
    flat = status_columns(known.withColumn("id", F.coalesce("id", removed)))
    op = F.when(F.col("text").isNull(), "delete").otherwise("add")
    return flat.withColumn("op", op).where(F.col("id").isNotNull())
