"""Byte-level BPE as numpy matrices: one padded row per distinct piece of text, bucketed by length.

A batch of whole texts is cut into pieces by the tokenizer's pattern. Distinct pieces become rows of
padded matrices of nearly equal length. In each round every row merges its leftmost pair of minimum
rank: pairs are looked up in a hash table, the winner is replaced and the row is moved together.
Rows without a pair that is left leave the matrix. Memory is bounded by the batch and by ``MATRIX``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import bounded_batches
from .words import slices

#: Cells of one padded matrix, if it has more than one row.
MATRIX = 1 << 20
#: Distinct pieces whose ids a task remembers; the memory starts anew beyond it.
REMEMBER = 200_000
#: Bytes from which a piece is merged on its own.
LONG = 256
_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """Encoder and decoder for one vocabulary whose ranks are also the ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        token = [b""] * size
        for text, rank in ranks.items():
            token[rank] = text
        self.lengths = np.array([len(t) for t in token], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self._pairs()
        self._forget()

    def _pairs(self) -> None:
        """Open-addressing table from a pair of ids to the id of its concatenation."""
        left, right, out = [], [], []
        for text, rank in self.ranks.items():
            for i in range(1, len(text)):
                a, b = self.ranks.get(text[:i]), self.ranks.get(text[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), out.append(rank)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        values = np.array(out, np.int32)
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table_key, self.table_value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = self.table_key[slot[todo]] == -1
            _, first = np.unique(slot[todo][free], return_index=True)
            put = todo[free][first]
            self.table_key[slot[put]], self.table_value[slot[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, _NONE where there is none (also beside padding, -1)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        found = self.table_key[slot]
        out = np.where(found == keys, self.table_value[slot], _NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            slot_at = (slot.flat[todo] + 1) & self.mask
            slot.flat[todo] = slot_at
            found_at = self.table_key[slot_at]
            hit = found_at == keys.flat[todo]
            out.flat[todo[hit]] = self.table_value[slot_at[hit]]
            todo = todo[~hit & (found_at != -1)]
        out[(left < 0) | (right < 0)] = _NONE
        return out

    def _merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Merge all rows of a padded matrix (padding -1, width at least 2) to the end."""
        out = np.full_like(ids, -1)
        rows = np.arange(len(ids))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            n, width = ids.shape
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(n), best]
            done = rank == _NONE
            if done.any():
                out[rows[done], :width] = ids[done]
                ids, ranks, rows, best, rank = ids[~done], ranks[~done], rows[~done], best[~done], rank[~done]
                n = len(rows)
                if not n:
                    break
            at = np.arange(n)
            ids[at, best] = rank
            if width == 2:
                out[rows, 0] = ids[:, 0]
                break
            # Every cell right of the merged pair moves one to the left, and so do the pairs; only
            # the two pairs beside the merged token are looked up.
            column = np.arange(width - 1)
            ids = np.take_along_axis(ids, column + (column > best[:, None]), axis=1)
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= best[:, None]), axis=1)
            right = np.flatnonzero(best < width - 2)
            ranks[right, best[right]] = self.pair_ranks(ids[right, best[right]], ids[right, best[right] + 1])
            left = np.flatnonzero(best > 0)
            ranks[left, best[left] - 1] = self.pair_ranks(ids[left, best[left] - 1], ids[left, best[left]])
        return out

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long piece: a round merges all pairs of minimum rank from the left.

        That equals merging them one by one unless a new neighbour pair has a lower rank; then only
        the leftmost is merged in that round.
        """
        while len(ids) > 1:
            ranks = self.pair_ranks(ids[:-1], ids[1:])
            rank = ranks.min()
            if rank == _NONE:
                break
            at = np.flatnonzero(ranks == rank)
            if len(at) > 1:  # of overlapping pairs every second one of a run counts
                run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
                begin = np.flatnonzero(np.concatenate([[True], np.diff(run) != 0]))
                at = at[(np.arange(len(at)) - begin[run]) % 2 == 0]
            merged = self._apply(ids, at, rank)
            if len(at) > 1:
                near = at - np.arange(len(at))
                new = np.unique(np.concatenate([near[near > 0] - 1, near[near < len(merged) - 1]]))
                if (self.pair_ranks(merged[new], merged[new + 1]) < rank).any():
                    merged = self._apply(ids, at[:1], rank)
            ids = merged
        return ids

    @staticmethod
    def _apply(ids: np.ndarray, at: np.ndarray, rank: int) -> np.ndarray:
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids = ids.copy()
        ids[at] = rank
        return ids[keep]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has.

        Whole tokens are taken directly, the rest goes to matrices of nearly equal length.
        """
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # pieces, ids, counts
        buckets: dict[int, list[int]] = {}
        whole, whole_ids = [], []
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                whole.append(i), whole_ids.append(rank)
            elif len(piece) > LONG:
                ids = self._merge_long(self.byte_id[np.frombuffer(piece, np.uint8)])
                found.append((np.array([i]), ids, np.array([len(ids)])))
            else:
                buckets.setdefault(len(piece) + len(piece) % 2 if len(piece) < 24 else -(-len(piece) // 16) * 16, []).append(i)
        found.append((np.array(whole, np.int64), np.array(whole_ids, np.int32), np.ones(len(whole), np.int64)))
        for width, members in buckets.items():
            step = max(1, MATRIX // width)
            for a in range(0, len(members), step):
                part = members[a : a + step]
                joined = b"".join([pieces[i].ljust(width, b"\0") for i in part])
                ids = self.byte_id[np.frombuffer(joined, np.uint8)].reshape(len(part), width)
                sizes = np.array([len(pieces[i]) for i in part])
                ids[np.arange(width) >= sizes[:, None]] = -1
                ids = self._merge_rows(ids)
                used = ids >= 0
                found.append((np.array(part), ids[used], used.sum(axis=1)))
        order = np.argsort(np.concatenate([f[0] for f in found]))
        counts = np.concatenate([f[2] for f in found])
        starts = np.cumsum(counts) - counts
        return gather(np.concatenate([f[1] for f in found]), starts[order], counts[order]), counts[order]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, every match of the pattern on its own."""
        cut = [self.split(t) for t in texts]
        distinct = set().union(*cut)
        new = list(distinct.difference(self.known))
        if len(self.known) + len(new) > REMEMBER:
            self._forget()
            new = list(distinct)
        ids, counts = self.encode_pieces([p.encode("utf-8") for p in new])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        starts = np.cumsum(self.counts) - self.counts
        number = self.known.__getitem__
        out = []
        for pieces in cut:
            at = np.fromiter(map(number, pieces), np.int64, len(pieces))
            out.append(gather(self.ids, starts[at], self.counts[at]))
        return out

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids."""
        return gather(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges ``flat[start : start + count]`` one after the other."""
    ends = np.cumsum(counts)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)``: the ids of every whole text, and the bytes they decode to.

    ``vocabulary`` is the path of a ``.tiktoken`` file that the driver can read; its few megabytes are
    sent to the tasks. Null counts as empty text and gives no ids. Null ids and repeated rows are encoded
    like others; nothing is shuffled. Other columns of ``docs`` are not looked at.
    """
    return _coded(docs, vocabulary, pattern, id_col, text_col, "doc_id long, ids array<int>, decoded binary", False)


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of the same ids and bytes, and the ``carry`` columns as strings."""
    return _coded(docs, vocabulary, pattern, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", True, carry)


def _coded(docs: DataFrame, vocabulary: str, pattern: str, id_col: str, text_col: str, schema: str, digests: bool, carry: Sequence[str] = ()) -> DataFrame:
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = bpe.encode(part.column("text").fill_null("").to_pylist())
                decoded = [bpe.decode(x) for x in ids]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | (_digests if digests else _arrays)(ids, decoded) | {c: part.column(c) for c in carry})

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).cast("string") for c in carry))
    return rows.mapInArrow(code, schema + "".join(f", {c} string" for c in carry))


def _arrays(ids: list[np.ndarray], decoded: list[bytes]) -> dict[str, pa.Array]:
    return {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.binary())}


def _digests(ids: list[np.ndarray], decoded: list[bytes]) -> dict[str, pa.Array]:
    return {
        "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
        "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
    }
