"""Join strategy by checked size: broadcast what is proven small, split hot keys otherwise."""

from __future__ import annotations

from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import materialize

#: A side is broadcast only if it has at most this many (narrow) rows.
SMALL_ROWS = 200_000
#: A key is hot when it holds more than this share of the rows, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.001
#: Number of pieces a hot key is split into.
HOT_PIECES = 64


_checked: WeakKeyDictionary[DataFrame, dict[int, bool]] = WeakKeyDictionary()


def fits(df: DataFrame, max_rows: int = SMALL_ROWS) -> bool:
    """True if ``df`` has at most ``max_rows`` rows. Stops reading once the bound is passed.

    The answer is kept as long as the frame is, so a plan that uses it often checks it once.
    """
    known = _checked.setdefault(df, {})
    if max_rows not in known:
        known[max_rows] = df.select(F.lit(1)).offset(max_rows).isEmpty()
    return known[max_rows]


def lookup_join(
    big: DataFrame,
    other: DataFrame,
    keys: str | Sequence[str],
    how: str = "inner",
    spread_on: str | None = None,
    max_rows: int = SMALL_ROWS,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Join ``big`` with a side whose size is not known beforehand.

    The other side is broadcast when a check proves it small. Beyond that the join shuffles;
    ``spread_on`` names a column of ``big`` that differs within a key and is used to split hot
    keys, for sides where one key can hold a large share of the rows. ``bound`` is a cheaper
    frame that cannot have fewer rows than ``other``; it is counted instead.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if fits(other if bound is None else bound, max_rows):
        return big.join(F.broadcast(other), keys, how)
    if spread_on is None:
        return big.join(other, keys, how)
    return split_hot_join(big, other, keys, how, spread_on)


def split_hot_join(
    big: DataFrame, other: DataFrame, keys: Sequence[str], how: str, spread_on: str, stored: bool = False, tasks: int | None = None
) -> DataFrame:
    """Shuffle join in which hot keys of ``big`` go to HOT_PIECES partitions instead of one.

    ``big`` is read once to count its keys and once to join, so it is written to the shared
    folder first unless it is a ``stored`` table; its plan would otherwise run for both.

    ``tasks`` is the number of tasks that join, where the rows found, not those read, are the work; else Spark takes
    fewer for small tables. Only the rows of hot keys are repeated on the other side. Works for inner, left, left_semi
    and left_anti joins, because each row of ``big`` still meets all of its partners.
    """
    keys = list(keys)
    if not stored:
        big = materialize(big, "split")
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t")).select("_t").scalar()
    hot = F.broadcast(counts.where(F.col("_n") > total * F.lit(HOT_SHARE)).select(*keys, F.lit(True).alias("_hot")))
    # A NULL key meets no partner, so its rows may go anywhere; they must not all meet in one task.
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    split = F.coalesce("_hot", F.lit(False)) | missing
    piece = F.when(split, F.pmod(F.xxhash64(spread_on), F.lit(HOT_PIECES)).cast("int")).otherwise(0)
    pieces = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_PIECES - 1))).otherwise(F.array(F.lit(0)))
    left = big.join(hot, keys, "left").withColumn("_piece", piece).drop("_hot")
    right = other.join(hot, keys, "left").withColumn("_piece", F.explode(pieces)).drop("_hot")
    if tasks is not None:
        left, right = (side.repartition(tasks, *keys, "_piece") for side in (left, right))
    return left.join(right, [*keys, "_piece"], how).drop("_piece")
