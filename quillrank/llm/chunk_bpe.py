"""Byte-level BPE with content-defined chunks that are encoded once.

Whole texts are cut where a rolling hash of the last bytes says so, so passages that documents share become
the same chunks wherever they stand. Of each chunk that several parts of the documents hold, one part encodes
it and the others are sent its ids; what only one part holds is encoded there, once too. A chunk's ids are those of the
text around it from its first common piece boundary on: joins between chunks are encoded anew, from the last
boundary that no later character can move, until a boundary of the new encoding agrees with one of the chunk's.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import materialize
from ..sizing import split_hot_join
from .exchange import LEAST_PARTS, PART_BYTES
from .registry import bounded_batches
from .words import PIECE, _Powers, mix, slices

#: Bytes the rolling hash sees, bits of it that are zero at a cut, and the least and most bytes of a chunk.
WINDOW, CUT_BITS, LEAST, MOST = 48, 10, 256, 4096
#: Bytes behind a boundary that can matter to it: a match of the pattern looks at three characters more at most.
MARGIN = 16
#: Bytes behind a join that are encoded anew at first.
AHEAD = 48
#: Bytes of text whose chunks are encoded together, if they are of more than one row.
TOGETHER = 1 << 18
#: Distinct pieces whose ids a task remembers, and rows it recalls as repeated, before the memory starts anew.
REMEMBER, RECALL = 700_000, 100_000
#: The pattern of byte-level pre-tokenizers, with classes of letters, numbers and white space by name.
PATTERN = "'(?:[stmd]|re|ve|ll)| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Characters that all versions of Unicode tables class alike, and the white space among them.
SETTLED, SPACES = ((0x0, 0x52F), (0x2010, 0x2027)), r"\t\n\x0b\x0c\r \x85\xa0"

_powers = _Powers(0x9E3779B97F4A7C15)
#: Stands for a module, so that coders outlive the task that made them in a worker.
_CODERS = "quillrank_chunk_coders"
_BYTES = mix(np.arange(1001, 1257, dtype=np.uint64))


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def piece_pattern() -> str:
    """PATTERN with the settled letters and numbers written out."""
    settled = [chr(c) for a, b in SETTLED for c in range(a, b + 1)]
    classes = {k: "".join(re.escape(c) for c in settled if unicodedata.category(c)[0] == k) for k in "LN"}
    return PATTERN.format(S=SPACES, **classes)


def cuts(text: bytes) -> list[int]:
    """Starts of the chunks of a text, the first at 0. They depend on the bytes nearby and on the last start."""
    n = len(text)
    data = np.frombuffer(text, np.uint8)
    found = []
    for a in range(0, max(n - WINDOW, 0), PIECE):
        part = data[a : a + PIECE + WINDOW]
        up, down = _powers.upto(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * up, out=total[1:])
        rolled = (total[WINDOW:-1] - total[: -WINDOW - 1]) * down[: len(part) - WINDOW]
        found.append(np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + a + WINDOW)
    out = [0]
    for cut in [*(np.concatenate(found).tolist() if found else ()), n]:
        while cut - out[-1] > MOST:
            out.append(_letter(data, out[-1] + MOST))
        if cut < n and cut - out[-1] >= LEAST and data[cut] & 0xC0 != 0x80:
            out.append(cut)
    return out


def _letter(data: np.ndarray, at: int) -> int:
    """The start of the character that holds byte ``at``."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _whole(data: bytes, end: int) -> int:
    """The first place from ``end`` on where no character is cut, the end of the text at most."""
    while end < len(data) and data[end] & 0xC0 == 0x80:
        end += 1
    return min(end, len(data))


class _Known(dict):
    """Numbers of pieces; a new one is encoded when it is first looked up."""

    def __init__(self, learn) -> None:
        self.learn = learn

    def __missing__(self, piece: str) -> int:
        self[piece] = number = self.learn(piece)
        return number


@dataclass
class Coded:
    """Ids of a text encoded by itself; for each of its pieces the first id and the first byte, and both totals."""

    ids: np.ndarray
    first: np.ndarray
    begin: np.ndarray

    def pack(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(self.ids), len(self.first)], "<i8").tobytes(), self.ids.astype("<u4").tobytes(), self.first.astype("<u4").tobytes(), self.begin.astype("<u4").tobytes()]))

    @staticmethod
    def unpack(packet: bytes) -> Coded:
        data = zstandard.ZstdDecompressor().decompress(packet)
        n, m = np.frombuffer(data, "<i8", 2)
        x = np.frombuffer(data, "<i4", offset=16)
        return Coded(x[:n], x[n : n + m], x[n + m :])


class ChunkCoder:
    """Encoder and decoder for one byte-level tokenizer file, given as its JSON text."""

    def __init__(self, text: str) -> None:
        self.tokenizer = Tokenizer.from_str(text)
        spec = json.loads(text)
        pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        if spec["normalizer"] is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level tokenizers without normalizer and prefix space")
        if spec["model"]["type"] != "BPE" or spec["model"].get("dropout") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"] for t in added):
            raise ValueError("only BPE without dropout, and added tokens that stand for themselves")
        number = {c: b for b, c in enumerate(byte_alphabet())}
        self.spelling = {b: c for c, b in number.items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.added = {t["content"].encode(): t["id"] for t in added}
        token = {i: bytes(number[c] for c in t) for t, i in vocabulary.items()} | {i: t for t, i in self.added.items()}
        # Arrays of bytes objects: numpy looks up many ids at once.
        self.bytes = np.array([*(token.get(i, b"") for i in range(max(token, default=-1) + 1)), None], object)[:-1]
        self.decimal = np.array([*(b"%d" % i for i in range(len(self.bytes))), None], object)[:-1]
        by_length = sorted((re.escape(t["content"]).encode() for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(by_length)) if added else None
        self.tokenize = self.tokenizer.model.tokenize
        self.find = re.compile(piece_pattern()).findall
        self.unsettled = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in SETTLED) + "]").search
        self._forget()

    def _forget(self) -> None:
        self.known = _Known(self._learn)
        # The first id and, for each piece, its number of ids, its bytes and where its ids start; numpy reads them in place.
        self.ids, self.tokens, self.sizes, self.starts = array("i", [0]), array("i"), array("i"), array("i")

    def _learn(self, piece: str) -> int:
        """Encode a new piece; returns its number."""
        number, word = len(self.tokens), piece[1:] if piece[0] == " " else piece
        if word.isascii() and word.isalnum():
            spelled, size = piece.replace(" ", self.spelling[32]), len(piece)
        else:
            raw = piece.encode("utf-8")
            spelled, size = raw.decode("latin-1").translate(self.spelling), len(raw)
        start = len(self.ids)
        self.ids.extend([t.id for t in self.tokenize(spelled)])
        self.tokens.append(len(self.ids) - start)
        self.sizes.append(size)
        self.starts.append(start)
        return number

    def _pieces(self, text: str) -> list[str]:
        """The pieces of a text; where tables of characters may differ, as the library cuts them."""
        if self.unsettled(text) is None:
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: bytes) -> Coded:
        """A text that holds no added token, by itself."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes]) -> list[Coded]:
        """Texts that hold no added token, each by itself; together, as a call of numpy costs more than a short text."""
        if len(self.known) > REMEMBER:
            self._forget()
        pieces, ends = [], [0]
        for text in texts:
            pieces += self._pieces(text.decode("utf-8"))
            ends.append(len(pieces))
        if not pieces:
            return [Coded(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)) for _ in texts]
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int32, len(pieces))
        ids, tokens, sizes, starts = (np.frombuffer(x, np.int32) for x in (self.ids, self.tokens, self.sizes, self.starts))
        counts = tokens[at]
        first, begin = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64)
        np.cumsum(counts, out=first[1:])
        np.cumsum(sizes[at], out=begin[1:])
        flat = ids[np.arange(first[-1]) + np.repeat(starts[at] - first[:-1], counts)]
        return [Coded(flat[first[a] : first[b]], first[a : b + 1] - first[a], begin[a : b + 1] - begin[a]) for a, b in zip(ends, ends[1:])]

    def segments(self, text: bytes) -> Iterator[tuple[int, int, int | None]]:
        """``(start, end, id)`` of added tokens, and with id None of what is between them."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield at, m.start(), None
            yield m.start(), m.end(), self.added[m.group()]
            at = m.end()
        if at < len(text):
            yield at, len(text), None

    def chunks(self, text: bytes) -> Iterator[bytes]:
        for a, b, token in self.segments(text):
            if token is None:
                starts = cuts(text[a:b])
                for x, y in zip(starts, [*starts[1:], b - a]):
                    yield text[a + x : a + y]

    def _safe(self, text: bytes, starts: list[int], coded: list[Coded]) -> list[int]:
        """For each chunk the pieces before its last boundary that nothing behind the chunk can move."""
        n = len(text)
        return [len(c.begin) - 1 if e == n else int(c.begin.searchsorted(e - s - MARGIN, "right")) - 1 for c, s, e in zip(coded, starts, [*starts[1:], n])]

    def _likely(self, text: bytes, starts: list[int], coded: list[Coded], safe: list[int]) -> list[tuple[int, int]]:
        """The windows that ``join`` asks for where chunks agree with the text up to near their ends."""
        return [(at := s + int(c.begin[i]), _whole(text, max(e, at) + AHEAD)) for s, e, c, i in zip(starts, starts[1:], coded, safe)]

    def join(self, text: bytes, starts: list[int], coded: list[Coded], safe: list[int], ready: dict[tuple[int, int], Coded]) -> list[np.ndarray]:
        """Ids of a whole text from those of its chunks; ``ready`` holds windows that are encoded already.

        ``at`` is always a boundary of the whole text's own pieces. Where the chunk that holds it has a boundary
        there too, both go on alike up to near the chunk's end.
        """
        ends, n, out, at, k, ahead = [*starts[1:], len(text)], len(text), [], 0, 0, AHEAD

        def agreed(k: int, at: int) -> int | None:
            """The piece of chunk ``k`` that begins at ``at`` and has safe ones behind it."""
            i = int(coded[k].begin.searchsorted(at - starts[k]))
            return i if i < safe[k] and coded[k].begin[i] == at - starts[k] else None

        while at < n:
            while ends[k] <= at:
                k += 1
            i = agreed(k, at)
            if i is not None:
                c = coded[k]
                out.append(c.ids[c.first[i] : c.first[safe[k]]])
                at = starts[k] + int(c.begin[safe[k]])
                continue
            end = _whole(text, max(ends[k], at) + ahead)
            window = ready.get((at, end)) or self.encode(text[at:end])
            sure = len(window.begin) - 1 if end == n else int(window.begin.searchsorted(end - at - MARGIN, "right")) - 1
            if sure <= 0:
                ahead *= 2
                continue
            ahead, upto, other = AHEAD, sure, k
            for p, place in enumerate((window.begin[1:sure] + at).tolist(), 1):
                while ends[other] <= place:
                    other += 1
                if agreed(other, place) is not None:
                    upto = p
                    break
            out.append(window.ids[: window.first[upto]])
            at += int(window.begin[upto])
        return out

    def encode_text(self, text: bytes, coded) -> np.ndarray:
        """Ids of a whole text; ``coded`` gives what a chunk is by itself."""
        return self.encode_texts([text], lambda chunks: [coded(c) for c in chunks])[0]

    def encode_texts(self, texts: list[bytes], coded) -> list[np.ndarray]:
        """Ids of whole texts; ``coded`` gives what each of a list of chunks is by itself."""
        found, parts, chunks = [], [], []
        for text in texts:
            found.append([np.zeros(0, np.int32)])
            for a, b, token in self.segments(text):
                if token is not None:
                    found[-1].append(np.array([token], np.int32))
                    continue
                part = text[a:b]
                starts = cuts(part)
                parts.append((part, starts, len(found) - 1, len(found[-1])))
                found[-1].append(None)
                chunks += [part[x:y] for x, y in zip(starts, [*starts[1:], b - a])]
        own, known, at = [], coded(chunks), 0
        for part, starts, _, _ in parts:
            of = known[at : at + len(starts)]
            at += len(starts)
            safe = self._safe(part, starts, of)
            own.append((of, safe, self._likely(part, starts, of, safe)))
        windows = iter(self.encode_all([part[a:b] for (part, *_), (_, _, likely) in zip(parts, own) for a, b in likely]))
        for (part, starts, row, place), (of, safe, likely) in zip(parts, own):
            found[row][place] = np.concatenate([np.zeros(0, np.int32), *self.join(part, starts, of, safe, {w: next(windows) for w in likely})])
        return [np.concatenate(x) for x in found]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.bytes[ids].tolist()).decode("utf-8", "replace")


def _key(chunk: bytes) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(chunk), "<i8").tolist()
    return a, b


def _batched(rows: Iterator[tuple[dict, bytes | None]]) -> Iterator[list[tuple[dict, bytes | None]]]:
    """Rows in lists of one, or of TOGETHER bytes of text at most."""
    held, size = [], 0
    for row, text in rows:
        if held and size + len(text or b"") > TOGETHER:
            yield held
            held, size = [], 0
        held.append((row, text))
        size += len(text or b"")
    if held:
        yield held


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)``: the ids of every whole text, and the text they decode to.

    ``vocabulary`` is the path of a tokenizer file that the driver can read. Added tokens in a text become their
    ids, as the library does. Null counts as empty text and gives no ids. Null ids are encoded like others; a repeated
    row is sent once by each task and comes out as often as it went in. An empty table gives no rows; other
    columns of ``docs`` are not looked at. The text is shuffled once, compressed.
    """
    return _coded(docs, vocabulary, id_col, text_col, False)


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of the same: digests of the decimal ids joined by commas, and of the text."""
    return _coded(docs, vocabulary, id_col, text_col, True)


def _coded(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    spec_key = xxhash.xxh3_128_hexdigest(spec.value)
    ChunkCoder(spec.value)  # tells at once if the file is of another kind
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    parts = max(LEAST_PARTS, total // PART_BYTES)
    tag = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), tag.alias("tag"), F.pmod(tag, F.lit(parts)).cast("int").alias("part"))

    def coder() -> ChunkCoder:
        """One a worker process and tokenizer."""
        made, name = sys.modules.setdefault(_CODERS, types.ModuleType(_CODERS)).__dict__, f"coder_{spec_key}"
        if name not in made:
            made[name] = ChunkCoder(spec.value)
        return made[name]

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with the text where a task first sees it; how often it comes again follows, without."""
        compress = zstandard.ZstdCompressor(level=3).compress
        names, kinds = ["doc_id", "tag", "part", "times", "squeezed"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        again: dict[tuple, int] = {}

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        def rest() -> pa.RecordBatch:
            out = batch_of([(*key, n, None) for key, n in again.items() if n])
            again.clear()
            return out

        for batch in batches:
            out = []
            for doc, text, tag_, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "tag", "part"))):
                key = (doc, tag_, part)
                if key in again:
                    again[key] += 1
                else:
                    again[key] = 0
                    out.append((*key, 1, compress(text.encode("utf-8"))))
            yield batch_of(out)
            if len(again) > RECALL:
                yield rest()
        yield rest()

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder()
        for batch in batches:
            for piece in slices(batch):
                texts, part = piece.column("text").to_pylist(), piece.column("part").to_pylist()
                found = list({(*_key(c), p) for t, p in zip(texts, part) for c in own.chunks(t.encode("utf-8"))})
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["d1", "d2", "part"])

    def texts_of(docs: pa.Table) -> Iterator[tuple[dict, bytes]]:
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in docs.to_batches(max_chunksize=64):
            for row in batch.to_pylist():
                yield row, None if row["squeezed"] is None else decompress(row["squeezed"])

    def publish(docs: pa.Table, owned: pa.Table) -> pa.Table:
        """Ids of the chunks that this part encodes for others."""
        wanted = set(zip(owned.column("d1").to_pylist(), owned.column("d2").to_pylist()))
        out: list[tuple[int, int, bytes]] = []
        if wanted:
            for some in _batched(texts_of(docs)):
                mine = {}
                for _, text in some:
                    for chunk in coder().chunks(text or b""):
                        if (key := _key(chunk)) in wanted:
                            wanted.remove(key)
                            mine[key] = chunk
                out += [(*key, coded.pack()) for key, coded in zip(mine, coder().encode_all([*mine.values()]))]
        return pa.table({c: pa.array([o[i] for o in out], k) for i, (c, k) in enumerate((("d1", pa.int64()), ("d2", pa.int64()), ("packet", pa.binary())))})

    def assemble(docs: pa.Table, sent: pa.Table) -> pa.Table:
        packets = dict(zip(zip(sent.column("d1").to_pylist(), sent.column("d2").to_pylist()), sent.column("packet").to_pylist()))
        known: dict[tuple, Coded] = {}

        def coded(chunks: list[bytes]) -> list[Coded]:
            keys = [_key(chunk) for chunk in chunks]
            new = {key: chunk for key, chunk in zip(keys, chunks) if key not in known}
            known.update((key, Coded.unpack(packets.pop(key))) for key in new.keys() & packets.keys())
            new = {key: chunk for key, chunk in new.items() if key not in known}
            known.update(zip(new, coder().encode_all([*new.values()])))
            return [known[key] for key in keys]

        results: dict[bytes, tuple] = {}
        by_tag: dict[tuple, tuple] = {}
        out, later = [], []
        for some in _batched(texts_of(docs)):
            digest = [None if text is None else xxhash.xxh3_128_digest(text) for _, text in some]
            new = {d: text for d, (_, text) in zip(digest, some) if d is not None and d not in results}
            for d, ids in zip(new, coder().encode_texts([*new.values()], coded)):
                decoded = coder().decode(ids)
                results[d] = (len(ids), hashlib.sha256(b",".join(coder().decimal[ids].tolist())).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()) if digests else (ids.tolist(), decoded)
            for d, (row, _) in zip(digest, some):
                name = (row["doc_id"], row["tag"])
                if d is None:
                    later.append((name, row["times"]))
                    continue
                by_tag[name] = results[d]
                out.append((row["doc_id"], *results[d]))
        out += [(name[0], *by_tag[name]) for name, times in later for _ in range(times)]
        return pa.table({c: pa.array([o[i] for o in out], k) for i, (c, k) in enumerate(columns)})

    columns = [("doc_id", pa.int64()), *([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())])]
    schema = "doc_id long, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    asked = materialize(rows.mapInArrow(requests, "d1 long, d2 long, part int").distinct(), "asked")
    shared = asked.groupBy("d1", "d2").agg(F.min("part").alias("owner"), F.max("part").alias("top")).where("owner < top").drop("top")
    shared = materialize(shared, "shared")
    wanted = materialize(split_hot_join(asked, shared, ["d1", "d2"], "inner", "part", stored=True).where("part != owner").drop("owner"), "wanted")
    by_part = rows.mapInArrow(squeeze, "doc_id long, tag long, part int, times long, squeezed binary").groupBy("part")
    owned = shared.select(F.col("owner").alias("part"), "d1", "d2")
    published = by_part.cogroup(owned.groupBy("part")).applyInArrow(publish, "d1 long, d2 long, packet binary")
    sent = split_hot_join(wanted, published, ["d1", "d2"], "inner", "part", stored=True)
    return by_part.cogroup(sent.groupBy("part")).applyInArrow(assemble, schema)
