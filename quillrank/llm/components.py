"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sizing import lookup_join


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``(a, b)``; the component is the smallest id reachable.

    Each step connects the neighbours of an id with its smallest neighbour, until every id points at the
    smallest of its component. Links that a step makes anew are counted once; ids with very many links
    are split where they are joined. Links that are null or join an id with itself add nothing.
    """
    high, low = F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")
    stars = materialize(links.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(high, low).distinct(), "links")
    mark = None
    while True:
        both = stars.select(F.col("high").alias("id"), F.col("low").alias("other")).unionByName(stars.select(F.col("low").alias("id"), F.col("high").alias("other")))
        smallest = both.groupBy("id").agg(F.min("other").alias("least")).select("id", F.least("id", "least").alias("least"))
        above = lookup_join(both.where("other > id"), materialize(smallest, "least"), "id", spread_on="other")
        large = materialize(above.where("other != least").select(F.col("other").alias("high"), F.col("least").alias("low")).distinct(), "large")
        smallest = large.groupBy("high").agg(F.min("low").alias("least"))
        beside = lookup_join(large, materialize(smallest, "least"), "high", spread_on="low")
        small = beside.where("low != least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        stars = materialize(small.unionByName(beside.select("high", F.col("least").alias("low"))).distinct(), "stars")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    lowest = stars.select(F.col("low").alias("id"), F.col("low").alias("component")).distinct()
    return stars.select(F.col("high").alias("id"), F.col("low").alias("component")).unionByName(lowest)
