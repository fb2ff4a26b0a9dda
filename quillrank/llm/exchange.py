"""Find equal keys over all rows with compact packets instead of a row per key.

A task sorts the records it has seen. Keys that it holds once go, with the place they come from, to the
bucket of the key. A key that it holds several times is repeated for certain, so its places are reported
right away and the bucket only gets the key: a key meets at most one record per task there, however
often it occurs. Buckets grow in number with the input, so what a task gets is bounded.

A place is ``(doc, tag, pos)``: document id, 32 bits of a hash of id and text, and a position. Packets that
report places are addressed to the part of the documents that ``tag`` belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Records a task holds before it sends them.
CHUNK = 2_000_000
#: Bytes of text for one bucket of keys and for one part of the documents, and how many there are at least.
BUCKET_BYTES, LEAST_BUCKETS = 1 << 24, 1024
PART_BYTES, LEAST_PARTS = 1 << 23, 512
#: Stands for a null id in packets.
NO_ID = -(2**63)
PACKET = "bucket int, part int, packet binary"
REPORT = "part int, packet binary"

_KINDS = {"key": np.uint64, "key2": np.uint32, "doc": np.int64, "tag": np.uint32, "pos": np.uint32, "more": np.uint8}
RECORD = ("key", "key2", "doc", "tag", "pos", "more")
PLACE = ("doc", "tag", "pos")


def pack(columns: dict[str, np.ndarray], compress) -> bytes:
    """Columns of equal length as bytes, the planes of equal significance together, compressed."""
    n = len(next(iter(columns.values())))
    planes = [np.ascontiguousarray(columns[c], _KINDS[c]).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns]
    return compress(b"".join([np.int64(n).tobytes(), *planes]))


def unpack(packets: list[bytes], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The columns of several packets, one after the other."""
    found: dict[str, list[np.ndarray]] = {c: [np.zeros(0, _KINDS[c])] for c in names}
    decompress = zstandard.ZstdDecompressor().decompress
    for packet in packets:
        data = np.frombuffer(decompress(packet), np.uint8)
        n, at = int(data[:8].view(np.int64)[0]), 8
        for c in names:
            width = np.dtype(_KINDS[c]).itemsize
            found[c].append(np.ascontiguousarray(data[at : at + n * width].reshape(width, n).T).view(_KINDS[c]).ravel())
            at += n * width
    return {c: np.concatenate(x) for c, x in found.items()}


def _runs(key: np.ndarray, key2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the records by key, and for each in that order the number of its run."""
    order = np.lexsort((key2, key))
    k, k2 = key[order], key2[order]
    return order, np.cumsum(np.concatenate([[False], (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])])) if len(k) else np.zeros(0, np.int64)


def _cut(by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(value, rows)`` for each value of ``by``."""
    order = np.argsort(by, kind="stable")
    edges = np.flatnonzero(np.diff(by[order])) + 1
    for rows in np.split(order, edges) if len(order) else []:
        yield int(by[rows[0]]), rows


class Sender:
    """Collects records of one task and gives packets."""

    def __init__(self, buckets: int, parts: int) -> None:
        self.buckets, self.parts = buckets, parts
        self.held: list[dict[str, np.ndarray]] = []
        self.size = 0

    def add(self, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(columns)
        self.size += len(columns["key"])
        if self.size >= CHUNK:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        all_ = {c: np.concatenate([h[c] for h in self.held]) for c in self.held[0]}
        self.held, self.size = [], 0
        order, run = _runs(all_["key"], all_["key2"])
        count = np.bincount(run)
        first = np.concatenate([[True], run[1:] != run[:-1]])
        record = {c: x[order][first] for c, x in all_.items()}
        record["more"] = (count > 1).astype(np.uint8)
        several = record["more"] == 1
        for c in PLACE:
            record[c] = np.where(several, 0, record[c]).astype(_KINDS[c])
        compress = zstandard.ZstdCompressor(level=1).compress
        yield self._batch([(b, -1, pack({c: record[c][rows] for c in RECORD}, compress)) for b, rows in _cut((record["key"] ^ record["key2"]) % np.uint64(self.buckets))])
        again = order[count[run] > 1]
        yield self._batch([(p % self.buckets, p, pack({c: all_[c][again][rows] for c in PLACE}, compress)) for p, rows in _cut(all_["tag"][again] % self.parts)])

    @staticmethod
    def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], ["bucket", "part", "packet"])


def repeated_places(packets: DataFrame, parts: int) -> DataFrame:
    """``(part, packet)``: the places of all keys that occur more than once."""

    def find(group: pa.Table) -> pa.Table:
        part = group.column("part").to_numpy()
        packet = group.column("packet").to_pylist()
        record = unpack([x for p, x in zip(part, packet) if p < 0], RECORD)
        order, run = _runs(record["key"], record["key2"])
        size, more = np.bincount(run, minlength=1), np.bincount(run, weights=record["more"][order], minlength=1)
        again = order[((size > 1) | (more > 0))[run] & (record["more"][order] == 0)]
        compress = zstandard.ZstdCompressor(level=1).compress
        found = [(p, pack({c: record[c][again][rows] for c in PLACE}, compress)) for p, rows in _cut(record["tag"][again] % parts)]
        found += [(p, x) for p, x in zip(part, packet) if p >= 0]
        return pa.table({"part": pa.array([f[0] for f in found], pa.int32()), "packet": pa.array([f[1] for f in found], pa.binary())})

    return packets.groupBy("bucket").applyInArrow(find, REPORT)
