"""Substring dedup with difference-cover anchors.

A window of words is repeated if the same words start anywhere else. Instead of hashing the window at
each word, only shorter anchors are hashed, at positions whose remainder modulo a period is in a
difference cover: of two equal windows, some pair of aligned positions is in the cover for both, so they
share an anchor. Documents that hold a repeated anchor are then extended: the windows around it
are compared in full length by 96-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import BUCKET_BYTES, LEAST_BUCKETS, LEAST_PARTS, NO_ID, PACKET, PART_BYTES, PLACE, Sender, repeated_places, unpack
from .registry import bounded_batches
from .words import Words, slices

#: Words of a window, and of the period of the anchors.
WINDOW = 35
PERIOD = 21
#: A perfect difference set modulo 21; every remainder is a difference of two of them.
COVER = (0, 1, 4, 14, 16)
_SECOND = 0xA24BAED4963EE407


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``, one row per row of ``docs``.

    Each word that a repeated window covers is removed; ``kept`` has the others joined by one space. Windows
    are judged on the input. ``window`` is at least PERIOD.

    Null text has no words. Rows that repeat a document are copies of each other, so their windows are
    repeated. Rows with a null id are documents like others. An empty table gives no rows; other columns of
    ``docs`` are not looked at. The text is shuffled once, compressed, for both
    passes that need it.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD}")
    anchor = window - PERIOD + 1
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets, parts = max(LEAST_BUCKETS, total // BUCKET_BYTES), max(LEAST_PARTS, total // PART_BYTES)
    tag = F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND(F.lit(0xFFFFFFFF))
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), tag.alias("tag"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [None if t is None else compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            part = pa.array(batch.column("tag").to_numpy() % parts, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), part, pa.array(texts, pa.binary())], ["doc_id", "tag", "part", "squeezed"])


    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_cover = np.isin(np.arange(PERIOD), COVER)
        sender = Sender(buckets, parts)
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                text, pos = words.place()
                at = np.flatnonzero(in_cover[pos % PERIOD] & (pos + anchor <= np.diff(words.first)[text]))
                key = words.windows(anchor)[at] >> np.uint64(16) if len(at) else np.zeros(0, np.uint64)
                yield from sender.add(key=key, key2=np.zeros(len(at), np.uint32), **_places(part, text[at], pos[at]))
        yield from sender.send()

    def extend(docs: pa.Table, found: pa.Table) -> pa.Table:
        sender = Sender(buckets, parts)
        out = []
        for part, words, at in _flagged(docs, found):
            text, pos = words.place()
            near = _covered(np.maximum(at - (PERIOD - 1), words.first[text[at]]), at + 1, len(text))
            at = np.flatnonzero(near & (pos + window <= np.diff(words.first)[text]))
            if len(at):
                key, key2 = words.windows(window)[at], (words.windows(window, _SECOND)[at] >> np.uint64(32)).astype(np.uint32)
                out += sender.add(key=key, key2=key2, **_places(part, text[at], pos[at]))
        return pa.Table.from_batches([*out, *sender.send()], schema=Sender._batch([]).schema)

    def remove(docs: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for part, words, at in _flagged(docs, found):
            text, _ = words.place()
            removed = _covered(at, at + window, len(text))
            counts = np.bincount(text[removed], minlength=part.num_rows) if len(text) else np.zeros(part.num_rows, np.int64)
            out.append(pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_words": pa.array(np.diff(words.first), pa.int64()),
                "n_removed": pa.array(counts, pa.int64()), "kept": words.join(~removed),
            }))
        return pa.Table.from_batches(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    by_part = rows.mapInArrow(squeeze, "doc_id long, tag long, part int, squeezed binary").groupBy("part")
    first = repeated_places(rows.mapInArrow(anchors, PACKET), parts)
    windows = by_part.cogroup(first.groupBy("part")).applyInArrow(extend, PACKET)
    second = repeated_places(windows, parts)
    return by_part.cogroup(second.groupBy("part")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


def _places(part: pa.RecordBatch, text: np.ndarray, pos: np.ndarray) -> dict[str, np.ndarray]:
    doc = part.column("doc_id").fill_null(NO_ID).to_numpy()
    return {"doc": doc[text], "tag": part.column("tag").to_numpy().astype(np.uint32)[text], "pos": pos.astype(np.uint32)}


def _covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words are in one of the ranges."""
    step = np.bincount(begin, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(end, n), minlength=n + 1)[: n + 1]
    return np.cumsum(step)[:n] > 0


def _flagged(docs: pa.Table, found: pa.Table) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    """Slices of the documents, their words, and the numbers of the words at reported places."""
    place = unpack(found.column("packet").to_pylist(), PLACE)
    order = np.lexsort((place["tag"], place["doc"]))
    doc, tag, pos = (place[c][order] for c in PLACE)
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])) if len(doc) else np.zeros(0, np.int64)
    ranges = {(int(doc[a]), int(tag[a])): (a, b) for a, b in zip(edge, [*edge[1:], len(doc)])}
    decompress = zstandard.ZstdDecompressor().decompress
    for part in slices(docs, "squeezed"):
        texts = [b"" if z is None else decompress(z) for z in part.column("squeezed").to_pylist()]
        words = Words(pa.array(texts, pa.binary()).view(pa.string()))
        at = [np.zeros(0, np.int64)]
        for row, key in enumerate(zip(part.column("doc_id").fill_null(NO_ID).to_pylist(), part.column("tag").to_pylist())):
            if key in ranges:
                a, b = ranges[key]
                at.append(words.first[row] + pos[a:b].astype(np.int64))
        yield part, words, np.concatenate(at)
