"""Web record collections: WARC of two versions and tagged text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread


def list_inputs(spark: SparkSession, suffix: str = ".warc.gz", skip: str = "OtherData", skip_corrupt: bool = False):
    """Reader options for a collection folder: all depths, one file suffix.

    An unreadable file is an error; with ``skip_corrupt`` what follows the damage is left out silently.

    Returns a reader and the condition that leaves out the skipped subtree.
    """
    reader = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}")
        .option("ignoreCorruptFiles", str(skip_corrupt).lower())
    )
    wanted = ~F.contains(F.col("_metadata.file_path"), F.lit(f"/{skip}/")) if skip else F.lit(True)
    return reader, wanted


class _Walker:
    """Records of one file, taken from its bytes as they come, a step a record.

    What is fed ends with a line. A record that is not complete yet waits, with the number of bytes it needs if its
    header is known, so a long payload is joined once.
    """

    def __init__(self, version: str) -> None:
        self.mark = re.compile(rb"(?m)^" + re.escape(version.encode()) + rb"\r*\n")
        self.blank, self.length = re.compile(rb"(?m)^\r*\n"), re.compile(rb"(?mi)^content-length:[ \t]*([^\r\n]*?)[ \t]*\r*$")
        self.held: list[bytes] = []
        self.size = self.need = 0

    def feed(self, data: bytes, last: bool = False) -> Iterator[tuple[bytes, bytes, bool]]:
        """``(head, payload, rejected)`` of the records that are complete, and at the ``last`` of what is left of one."""
        self.held.append(data)
        self.size += len(data)
        if self.size < self.need and not last:
            return
        data, at = b"".join(self.held), 0
        self.held, self.size, self.need = [], 0, 0
        while begin := self.mark.search(data, at):
            end = self.blank.search(data, begin.end())
            if end is None:
                if last:
                    yield data[begin.end() :], b"", True
                else:
                    self._wait(data[begin.start() :], 0)
                return
            head, at = data[begin.end() : end.start()], end.end()
            sizes = self.length.findall(head)
            if not sizes or not sizes[-1].isdigit():  # a record without a length can't be cut
                yield head, b"", True
                continue
            stop = at + int(sizes[-1])
            if stop > len(data):
                if last:
                    yield head, data[at:], True
                else:
                    self._wait(data[begin.start() :], stop - begin.start())
                return
            yield head, data[at:stop], False
            at = stop

    def _wait(self, data: bytes, need: int) -> None:
        self.held, self.size, self.need = [data], len(data), need


def _warc_records(version: str):
    """Task function: lines of files, in order, to records that are cut by their stated length."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, walker = None, _Walker(version)

        def batch_of(records: list[tuple[bytes, bytes, bool]]) -> pa.RecordBatch:
            text = lambda raw: raw.decode("utf-8", "replace")
            columns = ([text(h.replace(b"\r\n", b"\n").rstrip(b"\r\n")) for h, _, _ in records], [text(p) for _, p, _ in records], [r for _, _, r in records])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.bool_()))], ["head", "payload", "rejected"])

        for batch in batches:
            files, lines = batch.column("file").to_numpy(), batch.column("line")
            edges = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)] if len(files) else [0]
            out: list[tuple[bytes, bytes, bool]] = []
            for a, b in zip(edges[:-1], edges[1:]):
                if files[a] != file:
                    out += walker.feed(b"", last=True)
                    file, walker = files[a], _Walker(version)
                out += walker.feed(b"\n".join(lines.slice(a, b - a).to_pylist()) + b"\n")
            yield batch_of(out)
        yield batch_of(list(walker.feed(b"", last=True)))

    return read


def read_warc(
    spark: SparkSession, path: str, version: str = "WARC/1.0", suffix: str = ".warc.gz", with_rejects: bool = False
) -> DataFrame:
    """``(doc_id, url, type, headers, content)`` of a WARC collection.

    A record begins with a version line and has as many bytes of payload as its header says, so a payload may hold
    any text and any bytes; bytes that are no UTF-8 become replacement characters, one record at a time. Records
    that their file cuts short, or without a length, are left out or come out with ``rejected = true``. Files
    must be gzip, which is not splittable: a file is read in order by one task.
    """
    if not suffix.endswith(".gz"):
        raise ValueError("WARC files must be gzip")
    reader, wanted = list_inputs(spark, suffix)
    lines = reader.option("lineSep", "\n").text(path).where(wanted)
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"))
    split = lines.mapInArrow(_warc_records(version), "head string, payload string, rejected boolean")
    fields = F.filter(F.split("head", "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(fields, lambda x: F.struct(F.trim(F.split(x, ":", 2)[0]), F.trim(F.split(x, ":", 2)[1])))
    latest = F.aggregate(
        pairs,
        F.array().cast("array<struct<k:string,v:string>>"),
        lambda acc, p: F.concat(F.filter(acc, lambda q: q["k"] != p["col1"]), F.array(F.struct(p["col1"].alias("k"), p["col2"].alias("v")))),
    )
    parsed = split.select(F.map_from_entries(latest).alias("headers"), "payload", "rejected")
    inner = F.instr("payload", "Content-Length:")
    rest = F.when(inner > 0, F.substr("payload", inner)).otherwise(F.col("payload"))
    rest = F.substr(rest, F.instr(rest, "\n") + 1)
    first_tag = F.instr(rest, "<")
    if version.startswith("WARC/1"):
        content = F.when(first_tag > 0, F.substr(rest, first_tag)).otherwise(rest)
    else:
        content = rest
    out = parsed.select(
        F.col("headers")["WARC-TREC-ID"].alias("doc_id"),
        F.col("headers")["WARC-Target-URI"].alias("url"),
        F.col("headers")["WARC-Type"].alias("type"),
        "headers",
        content.alias("content"),
        "rejected",
    )
    return out if with_rejects else out.where(~F.col("rejected")).drop("rejected")


def read_trec_web(spark: SparkSession, path: str, suffix: str = ".gz", with_rejects: bool = False) -> DataFrame:
    """``(doc_id, url, type, content)`` of tagged text between ``<DOC>`` and ``</DOC>``.

    Lines are trimmed and joined by a space. A block without its tags, or with the header end
    before its start, is an error of the collection: it is left out, or comes out with
    ``rejected = true``.
    """
    reader, wanted = list_inputs(spark, suffix, skip="OtherData")
    blocks = reader.option("lineSep", "</DOC>").text(path).where(wanted).where(F.contains("value", F.lit("<DOC>")))
    inside = F.regexp_replace("value", r"(?s)^.*?<DOC>", "")
    joined = F.array_join(F.filter(F.transform(F.split(inside, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")
    doc = blocks.select(joined.alias("doc"))
    number = F.regexp_extract("doc", r"^<DOCNO>(.*?)</DOCNO>", 1)
    start, end = F.instr("doc", "<DOCHDR>"), F.instr("doc", "</DOCHDR>")
    out = doc.select(
        F.nullif(F.trim(number), F.lit("")).alias("doc_id"),
        F.lit(None).cast("string").alias("url"),
        F.lit("response").alias("type"),
        F.trim(F.substr("doc", end + len("</DOCHDR>"))).alias("content"),
        ((F.trim(number) == "") | (start == 0) | (end < start)).alias("rejected"),
    )
    return out if with_rejects else out.where(~F.col("rejected")).drop("rejected")


def web_documents(records: DataFrame) -> DataFrame:
    """``(doc_id, url, text)`` of the response records, page text extracted, empty pages dropped."""
    from ..functions.text import html_to_text
    from ..operators.filters import drop_empty, only_responses

    text = spread(only_responses(records)).select("doc_id", "url", html_to_text("content").alias("text"))
    return drop_empty(text)
