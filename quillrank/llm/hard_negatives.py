"""Hard negatives by exact integer scores: Strassen products of tiles, mergeable heaps of the best rows.

Rows are dealt over candidate tiles, anchors over anchor tiles, and every anchor tile meets every candidate
tile in a task of its own. There the int64 inner products come from Strassen's recursion on zero-padded
quadrants, whose sums are exact. Two passes follow the scores. The first only meets rows of the anchor's label
and keeps a heap of the best as positives. The second meets all rows and keeps, for each positive, a heap of
the best rows inside its window. A heap holds a few rows a tile, and heaps of different tiles merge.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of a candidate tile in which one task has its share, and of an anchor tile, about.
CANDIDATES, ANCHORS = 4096, 1024
#: Candidate tiles stop growing in number with the table only in proportion to it beyond this many rows.
LARGEST = 32_768
#: Rows of the blocks a task multiplies: anchors, candidates.
BLOCK_A, BLOCK_C = 256, 1024
#: Smallest side that the recursion splits.
LEAF = 32
_NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product of int64 matrices by seven half-sized products, odd sides padded by zeros.

    Exact as long as the entries of the product fit, since sums that overflow on the way wrap back.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) < LEAF:
        return a @ b
    i, j, l = -(-m // 2), -(-k // 2), -(-n // 2)
    a = np.pad(a, ((0, 2 * i - m), (0, 2 * j - k))) if (m | k) & 1 else a
    b = np.pad(b, ((0, 2 * j - k), (0, 2 * l - n))) if (k | n) & 1 else b
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1, p2, p3 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11), strassen(a11, b12 - b22)
    p4, p5 = strassen(a22, b21 - b11), strassen(a11 + a12, b22)
    p6, p7 = strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l], out[:i, l:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :l], out[i:, l:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The ``k`` best ``(score, id)`` of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, _NONE)

    def merge(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff([*first, len(slot)]))
        self.slot, self.score, self.id = (x[rank < self.k] for x in (slot, score, ids))
        full = rank == self.k - 1
        self.least[slot[full]] = score[full]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, padded by zeros up to ``width``."""
    column = column.combine_chunks()
    size = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy()
    return out


def _blocks(group: pa.Table, k: int):
    """Anchors, candidates sorted by id, and the scores of block after block."""
    side = np.asarray(group.column("side").to_numpy())
    anchors, rows = group.filter(pa.array(side == 0)), group.filter(pa.array(side == 1)).sort_by("vec_id")
    width = max([1, *(pa.compute.max(pa.compute.list_value_length(t.column("q"))).as_py() or 1 for t in (anchors, rows) if len(t))])
    a, c = _matrix(anchors.column("q"), width), _matrix(rows.column("q"), width)

    def scores():
        for i in range(0, len(a), BLOCK_A):
            for j in range(0, len(c), BLOCK_C):
                yield i, j, strassen(a[i : i + BLOCK_A], c[j : j + BLOCK_C].T)

    return anchors, rows, scores()


def _tiles(rows: int, least: int) -> int:
    return max(1, -(-rows // LARGEST), min(-(-rows // least), 24))


def _meet(anchors: DataFrame, rows: DataFrame, keys: list[str], anchor_tiles: int, row_tiles: int):
    """Every anchor tile with every candidate tile, both inside the same ``keys``."""
    a, c = F.pmod(F.xxhash64("row"), F.lit(anchor_tiles)), F.pmod(F.xxhash64("row"), F.lit(row_tiles))
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("side", F.lit(0)).withColumn("at", a).withColumn("ct", all_(row_tiles))
    right = rows.withColumn("side", F.lit(1)).withColumn("ct", c).withColumn("at", all_(anchor_tiles))
    return left.unionByName(right, allowMissingColumns=True).groupBy(*keys, "at", "ct")


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Rows for which ``anchor`` holds are anchors. Components count as ``floor(scale * x)`` and a score is the
    integer inner product. The positives of an anchor are its best ``n_positives`` other rows of its label; for
    each the best ``n_negatives`` rows of other labels are returned whose score times ``high`` is between ``low``
    and ``high`` times the positive's. Higher scores come first, ties by smaller id.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. A shorter
    vector counts as padded by zeros. Components are held within the bound up to which every score of its width
    fits 62 bits (2^28 at 64 components). A row that repeats an id is a row of its own: another row for the
    first one, and an anchor of its own where it is one. An anchor without positives or without rows in the
    window gives no rows, and so does an empty table; other columns are not looked at.
    """
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    most = F.least(F.floor(F.sqrt(F.lit(float(2**62)) / F.greatest(F.size(v), F.lit(1)))), F.lit(2**30)).cast("double")
    whole = F.transform(v, lambda x: F.greatest(-most, F.least(most, F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))).cast("int"))
    usable = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & ~bad)
    rows = usable.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), whole.alias("q"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    count = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a"))
    n, n_label, a, a_label = (x or 0 for x in count.agg(F.sum("n"), F.max("n"), F.sum("a"), F.max("a")).first())
    anchors = rows.where("anchor").drop("anchor")
    rows = rows.drop("anchor")

    def positives(group: pa.Table) -> pa.Table:
        anchors, rows, scores = _blocks(group, n_positives)
        row, ids, own = rows.column("row").to_numpy(), rows.column("vec_id").to_numpy(), anchors.column("row").to_numpy()
        heaps = Heaps(len(anchors), n_positives)
        for i, j, s in scores:
            s[own[i : i + BLOCK_A, None] == row[None, j : j + BLOCK_C]] = _NONE
            cut = heaps.least[i : i + len(s)]
            if s.shape[1] > n_positives:
                cut = np.maximum(cut, np.partition(s, -n_positives, axis=1)[:, -n_positives])
            x, y = np.nonzero((s >= cut[:, None]) & (s > _NONE))
            heaps.merge(x + i, s[x, y], ids[y + j])
        return pa.table({"row": own[heaps.slot], "positive_id": heaps.id, "positive_score": heaps.score})

    best = _meet(anchors, rows, ["label"], _tiles(a_label, ANCHORS), _tiles(n_label, CANDIDATES))
    best = best.applyInArrow(positives, "row long, positive_id long, positive_score long")
    first = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    best = best.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= n_positives)
    best = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("p"))
    anchors = anchors.join(best.select("row", F.col("p.positive_id").alias("p_id"), F.col("p.positive_score").alias("p_score")), "row")
    anchors = materialize(anchors, "anchors")

    def negatives(group: pa.Table) -> pa.Table:
        anchors, rows, scores = _blocks(group, n_negatives)
        ids = rows.column("vec_id").to_numpy()
        names, codes = np.unique(np.array(anchors.column("label").to_pylist() + rows.column("label").to_pylist(), object), return_inverse=True)
        own, other = codes[: len(anchors)], codes[len(anchors) :]
        p_id, p_score = _matrix(anchors.column("p_id"), n_positives), _matrix(anchors.column("p_score"), n_positives)
        there = np.arange(n_positives) < pa.compute.list_value_length(anchors.column("p_id")).to_numpy()[:, None]
        least = np.array([[-(-low * p // high) for p in each] for each in p_score.tolist()], np.int64).reshape(p_score.shape)
        bottom = np.where(there, least, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        top = np.where(there, p_score, _NONE).max(axis=1, initial=_NONE)
        heaps = Heaps(len(anchors) * n_positives, n_negatives)
        for i, j, s in scores:
            rows_ = slice(i, i + len(s))
            x, y = np.nonzero((s >= bottom[rows_, None]) & (s <= top[rows_, None]) & (own[rows_, None] != other[None, j : j + BLOCK_C]))
            score, id_, x = s[x, y], ids[y + j], x + i
            for nth in range(n_positives):
                slot = x * n_positives + nth
                in_ = there[x, nth] & (score >= least[x, nth]) & (score <= p_score[x, nth]) & (score >= heaps.least[slot])
                heaps.merge(slot[in_], score[in_], id_[in_])
        at, nth = np.divmod(heaps.slot, n_positives)
        return pa.table({
            "row": anchors.column("row").to_numpy()[at], "anchor_id": anchors.column("vec_id").to_numpy()[at], "nth": pa.array(nth, pa.int32()), "positive_id": p_id[at, nth],
            "positive_score": p_score[at, nth], "negative_id": heaps.id, "negative_score": heaps.score,
        })

    schema = "row long, anchor_id long, nth int, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _meet(anchors, rows, [], _tiles(a, ANCHORS), _tiles(n, CANDIDATES)).applyInArrow(negatives, schema)
    order = Window.partitionBy("row", "nth").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
