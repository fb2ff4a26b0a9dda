"""Embedding near-dedup by the epsilon grid order.

Unit vectors whose cosine is at least the threshold are at most epsilon apart, also in any projection. The
vectors are sorted by the cells, of side epsilon, that they have on the leading principal dimensions, and the
sequence is cut into intervals. Two intervals are joined only if their cells come within one of each other in
every leading dimension; inside, a join splits both intervals in halves and goes on as long as that holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sizing import split_hot_join
from .components import components
from .registry import bounded_batches

#: Leading dimensions that have cells.
LEADING = 6
#: Vectors of an interval, and of the smallest piece that a join splits.
INTERVAL, LEAF = 1024, 64
#: Vectors the principal dimensions are fitted on: those with the smallest hashes of their ids.
FIT_ROWS = 10_000
_CELLS = [f"c{i}" for i in range(LEADING)]
_GROUP = ["label", "dim"]
_SAME = [*_GROUP, "f1", "f2"]


def _unit(column: pa.Array) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Vectors of length one, None where there is none to be had, and how many components each has."""
    flat = column.fill_null([]).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
    out: list[np.ndarray | None] = []
    for v in np.split(flat, np.cumsum(size)[:-1]) if len(size) else []:
        most = np.abs(v).max(initial=0.0)
        if not len(v) or not np.isfinite(v).all() or most == 0:
            out.append(None)
        else:
            v = v / most
            out.append(v / np.sqrt(v @ v))
    return out, size


def _basis(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions, by number of components, from a bounded sample."""
    rows = vectors.where("unit IS NOT NULL").orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("dim", "unit").collect()
    found = {}
    for dim in {r.dim for r in rows}:
        x = np.array([r.unit for r in rows if r.dim == dim])
        x = x - x.mean(axis=0)
        found[dim] = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :LEADING]
    return found


def _apart(a: np.ndarray, b: np.ndarray) -> bool:
    """True if two sets of cells are too far from each other in some dimension."""
    return bool(((a.min(axis=0) - b.max(axis=0) > 1) | (b.min(axis=0) - a.max(axis=0) > 1)).any())


def join_intervals(unit: np.ndarray, cells: np.ndarray, a: slice, b: slice, threshold: float, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Append the row pairs of two intervals that are linked; of an interval with itself, each pair once."""
    if _apart(cells[a], cells[b]):
        return
    n, m = a.stop - a.start, b.stop - b.start
    if n <= LEAF and m <= LEAF:
        near = unit[a] @ unit[b].T >= threshold
        if a == b:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        out.append((i + a.start, j + b.start))
        return
    halves_a = [a] if n <= LEAF else [slice(a.start, a.start + n // 2), slice(a.start + n // 2, a.stop)]
    halves_b = [b] if m <= LEAF else [slice(b.start, b.start + m // 2), slice(b.start + m // 2, b.stop)]
    for x in halves_a:
        for y in halves_b:
            if a != b or x.start <= y.start:
                join_intervals(unit, cells, x, y, threshold, out)


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``.

    Two vectors are linked if their labels are equal and not null, they have equally many components, and
    their cosine in double precision is at least ``threshold``. Vectors that are null, zero, or hold null or
    non-finite components are linked with nothing. Equal directions are one node with a weight, so copies
    are never compared with each other.

    A row with a null id is linked with nothing, its component is null and it is kept. Rows that repeat an id
    and a vector are vectors of their own, linked with each other. An empty table gives no rows; other columns are
    not looked at.
    """
    eps = float(np.sqrt(2 - 2 * threshold)) * (1 + 1e-9)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, size = _unit(batch.column("v"))
            prints = [None if u is None else xxhash.xxh3_128_intdigest(u.tobytes()) for u in unit]
            signed = [[None if p is None else np.uint64(part(p)).view(np.int64).item() for p in prints] for part in (lambda p: p >> 64, lambda p: p & (2**64 - 1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(size, pa.int32()), pa.array(signed[0], pa.int64()), pa.array(signed[1], pa.int64()), pa.array(unit, pa.list_(pa.float64()))],
                ["vec_id", "label", "dim", "f1", "f2", "unit"],
            )

    rows = bounded_batches(vectors).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    rows = materialize(rows.mapInArrow(normal, "vec_id long, label string, dim int, f1 long, f2 long, unit array<double>"), "unit")
    usable = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND unit IS NOT NULL")
    nodes = materialize(usable.groupBy(*_SAME).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "nodes")
    reps = usable.select(*_SAME, "vec_id", "unit").join(nodes, _SAME).where("vec_id = rep").dropDuplicates([*_SAME]).drop("f1", "f2", "rep")
    basis = _basis(usable)

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for dim, u in zip(batch.column("dim").to_pylist(), batch.column("unit").to_pylist()):
                direction = basis.get(dim, np.eye(dim, min(dim, LEADING)))
                c = np.floor(np.array(u) @ direction / eps).astype(np.int32)
                cells.append(np.pad(c, (0, LEADING - len(c))))
            cells = np.array(cells, np.int32).reshape(-1, LEADING)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(cells[:, i]) for i in range(LEADING)]], [*batch.schema.names, *_CELLS])

    gridded = reps.mapInArrow(grid, f"label string, dim int, vec_id long, unit array<double>, weight long, {', '.join(f'{c} int' for c in _CELLS)}")
    order = [*_GROUP, *_CELLS, "vec_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number the intervals of a sorted partition; none goes over the border of a label."""
        number, filled, before = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            out = []
            for group in zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist()):
                if filled == INTERVAL or before not in (None, group):
                    number, filled = number + 1, 0
                before, filled = group, filled + 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "interval"])

    ordered = gridded.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"label string, dim int, vec_id long, unit array<double>, weight long, {', '.join(f'{c} int' for c in _CELLS)}, interval long"
    ordered = materialize(ordered.mapInArrow(cut, schema), "intervals")
    boxes = ordered.groupBy("interval", *_GROUP).agg(*[f(c).alias(f"{c}_{n}") for c in _CELLS for n, f in (("lo", F.min), ("hi", F.max))])
    boxes = materialize(boxes, "boxes")
    left = boxes.withColumn("cell", F.explode(F.sequence("c0_lo", "c0_hi")))
    right = boxes.select(*_GROUP, F.explode(F.sequence(F.col("c0_lo") - 1, F.col("c0_hi") + 1)).alias("cell"), F.col("interval").alias("other"), *[F.col(f"{c}_{n}").alias(f"{c}_{n}2") for c in _CELLS for n in ("lo", "hi")])
    near = F.col("interval") <= F.col("other")
    for c in _CELLS:
        near = near & (F.col(f"{c}_lo") - F.col(f"{c}_hi2") <= 1) & (F.col(f"{c}_lo2") - F.col(f"{c}_hi") <= 1)
    pairs = materialize(left.join(right, [*_GROUP, "cell"]).where(near).select("interval", "other").distinct(), "pairs")
    pair = F.struct("interval", "other").alias("pair")
    sides = pairs.select(pair, "interval").unionByName(pairs.where("interval != other").select(pair, F.col("other").alias("interval")))
    tasks = ordered.select("interval", "vec_id", "unit", "weight", *_CELLS).join(sides, "interval")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([("interval", "ascending"), *[(c, "ascending") for c in _CELLS], ("vec_id", "ascending")])
        interval, ids, weight = (group.column(c).to_numpy() for c in ("interval", "vec_id", "weight"))
        unit = np.array(group.column("unit").to_pylist())
        cells = np.stack([group.column(c).to_numpy() for c in _CELLS], axis=1)
        cut = int(np.searchsorted(interval, interval[0], "right"))
        a, b = slice(0, cut), slice(cut, len(ids)) if cut < len(ids) else slice(0, cut)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        join_intervals(unit, cells, a, b, threshold, found)
        i = np.concatenate([np.zeros(0, np.int64), *[f[0] for f in found]])
        j = np.concatenate([np.zeros(0, np.int64), *[f[1] for f in found]])
        links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        label = np.arange(len(ids))
        while True:  # the first row reachable inside this task
            new = label.copy()
            np.minimum.at(new, i, label[j])
            np.minimum.at(new, j, label[i])
            if (new == label).all():
                break
            label = new
        some = links > 0
        return pa.table({"vec_id": pa.array(ids[some], pa.int64()), "root": pa.array(ids[label][some], pa.int64()), "links": pa.array(links[some].astype(np.int64))})

    found = materialize(tasks.groupBy("pair").applyInArrow(compare, "vec_id long, root long, links long"), "found")
    linked = components(found.select(F.col("root").alias("a"), F.col("vec_id").alias("b")))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "rep")
    nodes = nodes.join(links, "rep", "left").join(linked.select(F.col("id").alias("rep"), "component"), "rep", "left")
    nodes = materialize(nodes.select(*_SAME, "rep", "weight", "links", "component"), "nodes")
    out = split_hot_join(rows.drop("unit"), nodes, _SAME, "left", "vec_id", stored=True)
    known = F.col("vec_id").isNotNull()
    n_links = F.when(known, F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).otherwise(0)
    component = F.when(known, F.coalesce("component", "rep", "vec_id"))
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
