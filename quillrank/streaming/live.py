"""A searchable table kept fresh from a stream of added and deleted statuses.

Each micro-batch appends one folder with the last message per id; nothing older is rewritten.
The live table is the compacted base without the ids the log has touched, plus the log rows
that are additions. ``compact_live`` folds the log into a new base now and then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokens
from ..operators import segments
from ..operators.postings import Analyzer, build_index
from ..operators.ranking import search
from ..session import materialize
from ..sizing import lookup_join
from ..versions import children, newest


def last_per_id(messages: DataFrame, order: Sequence[str]) -> DataFrame:
    """The last message per id in arrival order; one row per id and task before the shuffle."""
    rest = [c for c in messages.columns if c != "id"]
    last = messages.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select("id", "_last.*")


def ingest(stream: DataFrame, path: str, checkpoint: str, order: str | None = None, **trigger) -> StreamingQuery:
    """Write a stream with columns ``id`` and ``op`` (``add`` or ``delete``) to the live table.

    Arrival order is ``order`` where the source has such a column, or else its column ``arrival`` and the
    order of lines in a file. Without either, batches must hold one file each. A batch that is run again after a failure overwrites its own folder, so every
    message counts once. ``trigger`` sets the commit interval; the default drains what is there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = batch if order else batch.withColumn("_line", F.monotonically_increasing_id())
        known = [order] if order else [c for c in ("arrival", "_line") if c in numbered.columns]
        last = last_per_id(numbered, known).drop("_line", "arrival")
        last.write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def apply_deletes(base: DataFrame, log: DataFrame, batch: str = "batch") -> DataFrame:
    """Live rows of a base table and logged messages; a later addition of a deleted id counts again."""
    last = last_per_id(log, [batch])
    kept = lookup_join(base, last.select("id"), "id", "left_anti")
    added = last.where(F.col("op") == "add").drop("op", batch)
    return kept.unionByName(added, allowMissingColumns=True)


def _base_version(spark: SparkSession, path: str) -> int | None:
    names = (n for n in children(spark, f"{path}/base") if n.startswith("upto="))
    done = [int(n[5:]) for n in names if "_SUCCESS" in children(spark, f"{path}/base/{n}")]
    return max(done, default=None)


def live_table(spark: SparkSession, path: str) -> DataFrame:
    """The statuses that exist after the newest committed batch."""
    version = _base_version(spark, path)
    batches = children(spark, f"{path}/log")
    log = spark.read.parquet(f"{path}/log") if batches else None
    if version is None:
        if log is None:
            raise ValueError(f"no data below {path}")
        return last_per_id(log, ["batch"]).where(F.col("op") == "add").drop("op", "batch")
    base = spark.read.parquet(f"{path}/base/upto={version}")
    return base if log is None else apply_deletes(base, log.where(F.col("batch") > version))


def compact_live(spark: SparkSession, path: str) -> int:
    """Fold all committed batches into a new base; readers switch when it is complete."""
    newest = max(int(n.split("=")[1]) for n in children(spark, f"{path}/log") if n.startswith("batch="))
    live_table(spark, path).write.mode("overwrite").parquet(f"{path}/base/upto={newest}")
    return newest


def index_stream(
    stream: DataFrame, path: str, checkpoint: str, order: str | None = None, analyzer: Analyzer = tokens, feed: str = "stream", **trigger
) -> StreamingQuery:
    """Keep the index of ``operators.segments`` below ``path`` up to date with a stream as for ``ingest``.

    Each batch is one change: additions are put in, or replace the status they repeat, deletes take out. A search sees
    all of a batch or nothing of it. The index knows the number of the last batch of ``feed``, so a batch that is run
    again changes nothing; a new checkpoint needs a new ``feed``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = batch if order else batch.withColumn("_line", F.monotonically_increasing_id())
        known = [order] if order else [c for c in ("arrival", "_line") if c in numbered.columns]
        last = materialize(last_per_id(numbered.select(*dict.fromkeys(["id", "op", "text", *known])), known).select("id", "op", "text"), "batch")
        added = last.where("op = 'add' AND text IS NOT NULL").select(F.col("id").alias("doc_id"), "text")
        deleted = last.where("op = 'delete'").select(F.col("id").alias("doc_id"))
        segments.change(batch.sparkSession, path, added, deleted, analyzer=analyzer, source=(feed, batch_id), distinct=True)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def live_search(spark: SparkSession, path: str, text: str, n: int = 20, analyzer: Analyzer = tokens) -> DataFrame:
    """The best n statuses for a query text, in the newest version of the index that ``index_stream`` keeps.

    No status is tokenised; of postings and statistics only the folders of the query's terms are read. A folder that
    only ``ingest`` keeps has no index; its live table is indexed for the one search.
    """
    if newest(spark, path) is None:
        return search(build_index(live_table(spark, path), "id", "text", positions=False, analyzer=analyzer), text, n, analyzer)
    return search(segments.read_segments(spark, path), text, n, analyzer)


def archive_raw(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Raw message lines as gzip text; a second sink of the same stream with its own checkpoint."""
    return (
        stream.select("value")
        .writeStream.format("text")
        .option("path", path)
        .option("compression", "gzip")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
