"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sizing import lookup_join, split_hot_join
from .registry import unused

#: Characters of the second level's key.
PREFIX = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Rows are grouped by length; rows whose length nobody shares are done. Those left are grouped by
    length and hash of the prefix, and again only shared groups go on, to be grouped by the full
    digest. The text itself is read once and never shuffled: each level works on the keys. A level
    counts with partial sums, and the joins back to the rows split keys that hold many rows, so a
    group with a third of all rows is spread over many tasks.

    Of equal texts the row with the largest id stays. Null text counts as empty text. A null id is
    smaller than every id. Of rows that repeat the largest id of a group, exactly one stays. An empty
    table gives no rows; other columns of ``docs`` are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.octet_length(text).alias("bytes"),
            F.xxhash64(F.substring(text, 1, PREFIX)).alias("prefix"),
            F.sha2(text, 256).alias("text_sha256"),
        ),
        "digests",
    )
    several = F.count(F.lit(1)) > 1
    lengths = rows.groupBy("bytes").agg(several.alias("more")).where("more").select("bytes")
    prefixes = rows.groupBy("bytes", "prefix").agg(several.alias("more")).where("more").drop("more")
    prefixes = materialize(prefixes.join(lengths, "bytes", "left_semi"), "prefixes")
    left = split_hot_join(rows, prefixes, ["bytes", "prefix"], "left_semi", "row", stored=True)
    groups = left.groupBy("bytes", "prefix", "text_sha256").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")
    )
    groups = materialize(groups.where("group_size > 1"), "groups")
    found = split_hot_join(rows, groups, ["bytes", "prefix", "text_sha256"], "left", "row", stored=True)
    keep = F.coalesce("keep", F.struct("doc_id", "row"))
    return found.select(
        "doc_id",
        keep["doc_id"].alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (keep["row"] == F.col("row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` does not keep; all columns stay.

    The list of dropped rows is broadcast only if a check proves it small. Rows that repeat both an id
    and a text look the same in that list, so if there are any they are thinned out by the same key.
    """
    result = materialize(exact_dedup(docs, id_col, text_col), "dedup")
    name = unused(docs, "_key")

    def key(id_column, digest):
        return F.concat_ws(":", F.coalesce(id_column.cast("string"), F.lit("null")), digest).alias(name)

    dropped = result.where(~F.col("kept") & ~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    twins = result.where(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    marked = docs.withColumn(name, key(F.col(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    left = lookup_join(marked, dropped.select(key(F.col("doc_id"), F.col("text_sha256"))).distinct(), name, "left_anti", spread_on=name)
    if not twins.isEmpty():
        left = left.dropDuplicates([name])
    return left.select(*docs.columns)
