"""Near-duplicates by HyperMinHash: compressed registers, banding, corrected estimates, exact check.

A document's set of shingles becomes 256 registers. Each holds the smallest hash of its share of the hash
space, as the number of leading zeros and ten mantissa bits. Bands of six registers bring documents together
that may be linked: at a similarity of 0.85 a pair is missed with a probability of 2e-9. Documents that meet
form neighbourhoods; these are cut into blocks of bounded size, and pairs of blocks are estimated from the
registers, corrected for chance agreement, and then confirmed on the full sets. Members of a large neighbourhood
are compared with a few leaders first; those confirmed in one component are not compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sizing import lookup_join, split_hot_join
from .components import components
from .exchange import PACKET, CHUNK, LEAST_BUCKETS, Sender, _cut, pack, unpack
from .registry import bounded_batches
from .words import Words, mix, slices

SHINGLE = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 85
#: 2^8 registers, ten mantissa bits each, in bands of six.
LOG_REGISTERS, MANTISSA, BAND = 8, 10, 6
REGISTERS = 1 << LOG_REGISTERS
#: Attempts of an empty register to borrow from another.
BORROWS = 128
#: Standard deviations below the threshold at which an estimate still sends a pair to the exact check.
MARGIN = 5.0
#: Documents and shingles of a block; cells of a matrix that counts common shingles.
BLOCK_DOCS, BLOCK_SHINGLES, MATRIX = 96, 1_000_000, 15_000_000
#: Leaders of each class of set size in a large neighbourhood.
LEADERS = 3
_KEY_AND_DOC = ("key", "doc")


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and where each text begins.

    A-Z are lower-cased. A text with fewer words than a shingle has its whole sequence as the only one.
    """
    words = Words(column, lower=True)
    n = np.diff(words.first)
    text, pos = words.place()
    full = pos + SHINGLE <= n[text]
    short = (pos == 0) & (n[text] < SHINGLE)
    flat = np.zeros(len(text), np.uint64)
    at = np.flatnonzero(full)
    flat[at] = words.windows(SHINGLE)[at] if len(at) else 0
    for k in range(1, SHINGLE):
        at = np.flatnonzero(short & (n[text] == k))
        if len(at):
            flat[at] = mix(words.windows(k)[at] + np.uint64(k))
    used = full | short
    flat, text = flat[used], text[used]
    edge = np.searchsorted(text, np.arange(len(n) + 1))
    for a, b in zip(edge[:-1], edge[1:]):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (text[1:] != text[:-1])
    return flat[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def registers(flat: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A row of registers for each set; 0 is an empty register."""
    out = np.zeros((len(edge) - 1, REGISTERS), np.uint16)
    if not len(flat):
        return out
    doc = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    bucket = (flat >> np.uint64(64 - LOG_REGISTERS)).astype(np.int64)
    cell = doc * REGISTERS + bucket
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))  # sorted, so the smallest hash
    value = (flat[first] << np.uint64(LOG_REGISTERS)) >> np.uint64(11)  # 53 bits, exact as a float
    fraction, exponent = np.frexp(value.astype(np.float64))
    zeros = np.where(value == 0, 53, 53 - exponent)
    mantissa = np.where(value == 0, 0, ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64))
    out.ravel()[cell[first]] = (zeros << MANTISSA | mantissa) + 1
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of all pairs of two blocks of registers, and how many registers each rests on.

    Registers of unlike sets agree by chance; the expected number of such, for the size of the registers,
    is taken off (0.17 * 2^(p - r + 1), the published constant).
    """
    chance = 0.169919487159739 * 2.0 ** (LOG_REGISTERS - MANTISSA + 1)
    equal = np.empty((len(a), len(b)), np.float64)
    used = np.empty_like(equal)
    for i, row in enumerate(a):
        filled = (row != 0) | (b != 0)
        equal[i] = ((row == b) & filled).sum(axis=1)
        used[i] = filled.sum(axis=1)
    return np.maximum(equal - chance, 0) / np.maximum(used, 1), used


def filled(table: np.ndarray) -> np.ndarray:
    """Registers in which empty ones borrow from a filled one, the same way for all sets.

    Small sets leave most registers empty. Bands of those would bring together all sets that share one frequent
    shingle; with borrowed registers every band rests on several shingles, and agrees as often as the sets do.
    """
    out = table.copy()
    empty = out == 0
    order = np.random.default_rng(REGISTERS)
    for _ in range(BORROWS):
        if not empty.any():
            break
        lender = order.permutation(REGISTERS)
        rows = np.flatnonzero(empty.any(axis=1))
        out[rows] = np.where(empty[rows], table[rows][:, lender], out[rows])
        empty[rows] = out[rows] == 0
    for row in np.flatnonzero(empty.any(axis=1) & table.any(axis=1)):  # sets of one or two shingles
        have = np.flatnonzero(table[row])
        gap = np.flatnonzero(empty[row])
        out[row, gap] = table[row, have[np.searchsorted(have, gap) % len(have)]]
    return out


def band_keys(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of the bands of all sets that are not empty."""
    bands = filled(table)[:, : REGISTERS // BAND * BAND].reshape(len(table), -1, BAND).astype(np.uint64)
    key = np.zeros(bands.shape[:2], np.uint64)
    for i in range(BAND):
        key = mix(key + bands[:, :, i] + np.uint64(1))
    key = mix(key ^ np.arange(bands.shape[1], dtype=np.uint64))
    row, band = np.nonzero(bands.any(axis=2))
    return row, key[row, band]


def _stars(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of records with equal keys: the keys with their smallest document, and links of the others to it."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    least = doc[new][np.cumsum(new) - 1] if len(key) else doc
    pair = np.unique(np.stack([least, doc], axis=1)[least != doc], axis=0)
    return key[new], doc[new], pair


def _neighbours(reps: DataFrame, buckets: int) -> DataFrame:
    """``(a, b)``: links of documents with a common band to the smallest one with that band.

    A task links its own documents of a band and sends on only the smallest, so a band meets at most one
    record per task.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            key, doc, pair = _stars(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            compress = zstandard.ZstdCompressor(level=1).compress
            yield Sender._batch([(b, -1, pack({"key": key[rows], "doc": doc[rows]}, compress)) for b, rows in _cut(key % np.uint64(buckets))])
            where = mix(pair[:, 0].astype(np.uint64) + pair[:, 1].astype(np.uint64)) % np.uint64(buckets)
            yield Sender._batch([(b, 0, pair[rows].astype("<i8").tobytes()) for b, rows in _cut(where)])

        for batch in batches:
            table = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            row, key = band_keys(table)
            held.append((key, batch.column("doc_id").to_numpy()[row]))
            size += len(key)
            if size >= CHUNK:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    def meet(group: pa.Table) -> pa.Table:
        part = group.column("part").to_numpy()
        packet = group.column("packet").to_pylist()
        record = unpack([x for p, x in zip(part, packet) if p < 0], _KEY_AND_DOC)
        pair = _stars(record["key"], record["doc"])[2]
        own = [np.frombuffer(x, "<i8").reshape(-1, 2) for p, x in zip(part, packet) if p == 0]
        pair = np.unique(np.concatenate([pair.reshape(-1, 2), *own]), axis=0)
        return pa.table({"a": pa.array(pair[:, 0], pa.int64()), "b": pa.array(pair[:, 1], pa.int64())})

    return reps.mapInArrow(send, PACKET).groupBy("bucket").applyInArrow(meet, "a long, b long")


def _blocks(count, shingles):
    return F.ceil(F.greatest(F.col(count) / F.lit(BLOCK_DOCS), F.col(shingles) / F.lit(BLOCK_SHINGLES))).cast("int")


def _own(blocks="blocks"):
    return F.pmod(F.xxhash64("doc_id"), F.col(blocks)).cast("int")


def _counted(members: DataFrame, *key: str) -> DataFrame:
    return members.groupBy(*key).agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_s")).select(*key, _blocks("_c", "_s").alias("blocks"))


def _classed(members: DataFrame) -> DataFrame:
    """Add ``large`` and ``class`` to the members ``(doc_id, f1, n, hood)`` of neighbourhoods.

    A small neighbourhood is one class and one block. A large one is cut by classes of set size whose ratio is the
    threshold, so that only equal and adjacent classes can be linked.
    """
    hoods = _counted(members, "hood").select("hood", (F.col("blocks") > 1).alias("large"))
    step = F.lit(float(np.log(100 / PERCENT)))
    members = split_hot_join(members, materialize(hoods, "hoods"), ["hood"], "inner", "doc_id", stored=True)
    return materialize(members.withColumn("class", F.when(F.col("large"), F.floor(F.log("n") / step)).otherwise(0)), "classed")


def _leader_tasks(members: DataFrame) -> DataFrame:
    """``(task, side, doc_id, f1)``: each block of a large neighbourhood against the leaders of its class and of the next."""
    large = members.where("large")
    classes = materialize(_counted(large, "hood", "class"), "classes")
    leaders = large.groupBy("hood", "class", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(LEADERS)).alias("_k")).agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "f1")).alias("x"))
    leaders = materialize(leaders.select("hood", "class", "x.doc_id", "x.f1"), "leaders")
    leaders = leaders.unionByName(leaders.withColumn("class", F.col("class") - 1)).join(classes, ["hood", "class"])
    leaders = leaders.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
    blocks = split_hot_join(large, classes, ["hood", "class"], "inner", "doc_id", stored=True).withColumn("at", _own()).withColumn("side", F.lit(1))
    names = [F.xxhash64("hood", "class", F.lit("lead"), "at").alias("task"), "side", "doc_id", "f1"]
    return blocks.select(*names).unionByName(leaders.select(*names))


def _tasks(members: DataFrame) -> DataFrame:
    """``(task, side, doc_id, f1)``: the comparisons that each member takes part in, a row for each.

    ``members`` are classed and have the ``found`` component of those that leaders have confirmed. A class is cut into
    the confirmed of each component and the others, and these into blocks; blocks of equal and adjacent classes
    are compared unless both are of one component.
    """
    part = ["hood", "class", "sure", "of"]
    members = materialize(members.withColumn("sure", F.col("found").isNotNull()).withColumn("of", F.coalesce("found", F.lit(0))), "parts")
    parts = materialize(_counted(members, *part), "parts")
    a = parts.select("hood", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("near"), *[F.col(c).alias(f"a_{c}") for c in ("class", "sure", "of", "blocks")])
    b = parts.select("hood", F.col("class").alias("near"), *[F.col(c).alias(f"b_{c}") for c in ("class", "sure", "of", "blocks")])
    one, two = F.struct("a_class", "a_sure", "a_of"), F.struct("b_class", "b_sure", "b_of")
    settled = F.col("a_sure") & F.col("b_sure") & (F.col("a_of") == F.col("b_of"))
    pairs = a.join(b, ["hood", "near"]).where((one <= two) & ~settled)
    pairs = materialize(pairs.withColumn("pair", F.xxhash64("hood", one, two)).withColumn("same", one == two), "pairs")

    def seen_from(x: str, y: str, role: int) -> DataFrame:
        return pairs.select("hood", *[F.col(f"{x}_{c}").alias(c) for c in part[1:]], "pair", "same", F.lit(role).alias("role"), F.col(f"{x}_blocks").alias("mine"), F.col(f"{y}_blocks").alias("others"))

    partners = materialize(seen_from("a", "b", 0).unionByName(seen_from("b", "a", 1).where("NOT same")), "partners")
    rows = split_hot_join(members, partners, part, "inner", "doc_id", stored=True)
    rows = rows.withColumn("own", _own("mine")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    low = F.when(F.col("same"), F.least("own", "k")).when(F.col("role") == 0, F.col("own")).otherwise(F.col("k"))
    high = F.when(F.col("same"), F.greatest("own", "k")).when(F.col("role") == 0, F.col("k")).otherwise(F.col("own"))
    side = F.when(~F.col("same"), F.col("role")).when(F.col("k") == F.col("own"), -1).when(F.col("own") < F.col("k"), 0).otherwise(1)
    return rows.select(F.xxhash64("pair", low, high).alias("task"), side.alias("side"), "doc_id", "f1")


def _links(rows: DataFrame) -> DataFrame:
    """``(a, b)``: links that connect what is linked, from ``(task, side, doc_id, shingles)``.

    Side -1 stands for a block that is compared with itself; sides 0 and 1 are compared with each other.
    """

    def compare(group: pa.Table) -> pa.Table:
        doc, side = group.column("doc_id").to_numpy(), group.column("side").to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in group.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        edge = np.concatenate([[0], np.cumsum(size)])
        flat = np.concatenate(sets)
        table = registers(flat, edge)
        guess, used = estimate(table, table)
        goal = PERCENT / 100
        wanted = guess >= goal - MARGIN * np.sqrt(goal * (1 - goal) / np.maximum(used, 1))
        wanted &= (side[:, None] != side[None, :]) | (side[:, None] < 0)
        wanted &= 100 * np.minimum(size[:, None], size[None, :]) >= PERCENT * np.maximum(size[:, None], size[None, :])
        wanted = np.triu(wanted | wanted.T, 1)
        linked = np.zeros_like(wanted)
        if wanted.any():
            distinct, number = np.unique(flat, return_inverse=True)
            if len(sets) * len(distinct) <= MATRIX:
                cells = np.zeros((len(sets), len(distinct)), np.float32)
                cells[np.repeat(np.arange(len(sets)), size), number] = 1
                common = (cells @ cells.T).astype(np.int64)
            else:
                common = np.zeros(wanted.shape, np.int64)
                for i, j in np.argwhere(wanted):
                    common[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            linked = wanted & (100 * common >= PERCENT * (size[:, None] + size[None, :] - common))
        linked = linked | linked.T
        label = np.arange(len(doc))
        while True:  # the smallest row reachable inside this task
            new = np.minimum(label, np.where(linked, label[None, :], len(doc)).min(axis=1, initial=len(doc)))
            if (new == label).all():
                break
            label = new
        return pa.table({"a": pa.array(doc[label], pa.int64()), "b": pa.array(doc, pa.int64())}).filter(pa.array(label != np.arange(len(doc))))

    return rows.groupBy("task").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Documents are linked if 100 * intersection >= 85 * union of their sets of five-word shingles;
    ``component_id`` is the smallest id reachable over links and ``kept`` tells whether it is the own id.

    Equal sets are one node, so copies cost nothing further. Null, empty or blank texts have no shingles and
    are linked with nothing. A row with a null id is linked with nothing, its component is null and it is
    kept. Rows that share an id are one node, linked by any of their texts. An empty table gives no rows;
    other columns of ``docs`` are not looked at.
    """
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                flat, edge = shingle_sets(part.column("text"))
                prints = np.array([_print(flat[a:b]) for a, b in zip(edge[:-1], edge[1:])], np.uint64).view(np.int64).reshape(-1, 2)
                table = registers(flat, edge)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n": pa.array(np.diff(edge), pa.int64()), "f1": pa.array(prints[:, 0]), "f2": pa.array(prints[:, 1]),
                    "registers": pa.array([r.tobytes() for r in table], pa.binary()),
                })

    sketches = materialize(rows.mapInArrow(sketch, "doc_id long, n long, f1 long, f2 long, registers binary"), "sketches")
    node = ["f1", "f2", "n"]
    reps = sketches.where("n > 0 AND doc_id IS NOT NULL").groupBy(*node).agg(F.min("doc_id").alias("rep"))
    reps = materialize(reps, "nodes")
    banded = sketches.join(reps, node).where("doc_id = rep").select("doc_id", "registers")
    total = reps.count()
    hoods = components(_neighbours(banded, max(LEAST_BUCKETS, total // 20_000)))
    members = reps.select(F.col("rep").alias("doc_id"), "f1", "n").join(hoods.select(F.col("id").alias("doc_id"), F.col("component").alias("hood")), "doc_id")
    members = _classed(materialize(members, "members"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                flat, edge = shingle_sets(part.column("text"))
                found = [flat[a:b] for a, b in zip(edge[:-1], edge[1:])]
                mine = np.array([_print(s)[0] for s in found], np.uint64).view(np.int64) == part.column("f1").to_numpy()
                keep = pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "f1": part.column("f1"), "shingles": pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())})
                yield keep.filter(pa.array(mine))

    chosen = lookup_join(rows, materialize(members.select("doc_id", "f1"), "chosen"), "doc_id")
    full = materialize(chosen.select("doc_id", "f1", "text").mapInArrow(sets, "doc_id long, f1 long, shingles binary"), "sets")

    def compared(tasks: DataFrame) -> DataFrame:
        rows = split_hot_join(materialize(tasks, "tasks"), full, ["doc_id", "f1"], "inner", "task", stored=True)
        return materialize(_links(rows.select("task", "side", "doc_id", "shingles")), "links")

    none = F.lit(None).cast("long")
    if members.where("large").isEmpty():
        links = compared(_tasks(members.withColumn("found", none)))
    else:
        links = compared(_leader_tasks(members))
        sure = components(links).select(F.col("id").alias("doc_id"), F.col("component").alias("found"))
        links = links.unionByName(compared(_tasks(lookup_join(members, materialize(sure, "sure"), "doc_id", "left"))))
    linked = components(links)
    reps = reps.join(linked.select(F.col("id").alias("rep"), "component"), "rep", "left")
    reps = materialize(reps.select(*node, F.coalesce("component", "rep").alias("component_id")), "nodes")
    found = split_hot_join(sketches.drop("registers"), reps, node, "left", "doc_id", stored=True)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _print(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit fingerprint of a set, as two halves."""
    value = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return value >> 64, value & (2**64 - 1)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns stay."""
    dropped = near_duplicates(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct()
    return lookup_join(docs, materialize(dropped, "dropped"), id_col, "left_anti").select(*docs.columns)
