"""Running aggregates over a stream of statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import versions as vs
from ..operators.filters import within_area
from ..operators.geo import BOX, _cell, _cell_of, assign_city, user_post_frequency

#: Parts of a running aggregate that are read at most, before they are folded into one.
MOST_PARTS = 16
_BATCH = (T.StructField("batch", T.LongType()),)


def _centres_by_cell(cities: DataFrame, d: float) -> DataFrame:
    """``(_key, centres)``: one row per grid cell with the centres whose box may reach into it."""
    width = 2 * d
    shifts = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]
    cells = F.array_distinct(
        F.array(*(_cell(F.col("lon") + F.lit(x * width), F.col("lat") + F.lit(y * width), width) for x, y in shifts))
    )
    keyed = cities.select(F.explode(cells).alias("_key"), F.struct("lon", "lat").alias("c"))
    return keyed.groupBy("_key").agg(F.collect_list("c").alias("centres"))


def count_statuses(statuses: DataFrame, cities: DataFrame, d: float = BOX) -> DataFrame:
    """One row ``(n_indexed, n_geo, n_recognised)``; works on a batch and on a stream.

    ``n_recognised`` counts the cities whose strict box holds the status, over all cities. Each
    status is joined with one row of its grid cell, so the stream is not multiplied.
    """
    keyed = statuses.withColumn("_key", _cell_of("longitude", "latitude", 2 * d))
    met = keyed.join(_centres_by_cell(cities, d), "_key", "left")
    hits = F.size(F.filter("centres", lambda c: within_area(F.col("longitude"), F.col("latitude"), c["lon"], c["lat"], d)))
    located = F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    return met.agg(
        F.count(F.lit(1)).alias("n_indexed"),
        F.count_if(located).alias("n_geo"),
        F.coalesce(F.sum(F.when(F.col("centres").isNotNull(), hits)), F.lit(0)).alias("n_recognised"),
    )


def stream_counters(stream: DataFrame, cities: DataFrame, path: str, checkpoint: str, d: float = BOX, **trigger) -> StreamingQuery:
    """Keep the counters of everything seen so far below ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(path)

    return (
        count_statuses(stream, cities, d)
        .writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_user_frequency(
    stream: DataFrame, path: str, checkpoint: str, name: str, short_name: str, lon: float, lat: float, d: float = BOX, **trigger
) -> StreamingQuery:
    """Running post frequency per user; each batch writes the users it changed, once, as a part of a new version.

    When there are MOST_PARTS, they are folded into one with the newest row per user, and folders that no
    version of the last two needs are deleted. A batch that is run again after it was written changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, before = batch.sparkSession, vs.newest(batch.sparkSession, path)
        if before and before.notes["batch"] >= batch_id:
            return
        label = vs.new_label(before)
        batch.withColumn("batch", F.lit(batch_id).cast("bigint")).write.parquet(vs.place(path, "rows", label))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*batch.schema.fields, *_BATCH])
        version = vs.commit(spark, path, before, [*(before.parts if before else ()), label], {"batch": batch_id, "schema": schema})
        if len(version.parts) >= MOST_PARTS:
            fold_user_frequency(spark, path)

    return (
        user_post_frequency(stream, name, short_name, lon, lat, d)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def user_frequency(spark: SparkSession, path: str) -> DataFrame:
    """The newest row per user that ``stream_user_frequency`` wrote, as of the newest version."""
    version = vs.newest(spark, path)
    if version is None:
        raise ValueError(f"no data below {path}")
    return _newest_rows(spark, path, version).drop("batch")


def _newest_rows(spark: SparkSession, path: str, version: vs.Version) -> DataFrame:
    rows = vs.read_parts(spark, path, "rows", version.parts, version.notes["schema"]).drop("part")
    rest = [c for c in rows.columns if c != "user_id"]
    last = rows.groupBy("user_id").agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select("user_id", "_last.*")


def fold_user_frequency(spark: SparkSession, path: str) -> None:
    """Fold all parts into one and delete what neither this version nor the one before needs."""
    before = vs.newest(spark, path)
    label = vs.new_label(before)
    _newest_rows(spark, path, before).write.parquet(vs.place(path, "rows", label))
    vs.commit(spark, path, before, [label], before.notes)
    vs.vacuum(spark, path, ["rows"], keep=2)


def stream_city_match(stream: DataFrame, cities: DataFrame, path: str, checkpoint: str, d: float = BOX, **trigger) -> StreamingQuery:
    """City of each status as it arrives, by box or place; the city table is a static side."""

    def write(batch: DataFrame, batch_id: int) -> None:
        assign_city(batch, cities, d).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
