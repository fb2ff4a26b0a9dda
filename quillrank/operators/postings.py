"""Index build: analysed documents to postings, statistics and stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.stemming import stem_column, stem_words
from ..functions.text import tokens
from ..session import bounded_batches, materialize, shuffles_dropped, spread
from ..sizing import fits, lookup_join

Analyzer = Callable[[Column], Column]

#: Directories the stored postings are split into; a query reads only those of its terms.
TERM_BUCKETS = 64
#: Compression of the files of an index, which are read more often than written.
CODEC = "zstd"


def analyze(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", analyzer: Analyzer = tokens) -> DataFrame:
    """``(doc_id, tokens)``; missing text gives an empty array."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(analyzer(F.col(text)), F.array().cast("array<string>")).alias("tokens")
    )


def posting_rows(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    positions: bool = True,
    analyzer: Analyzer = tokens,
    words: pa.Array | None = None,
) -> DataFrame:
    """``(doc_id, term, tf, [positions], dl, head)`` without any shuffle.

    A document is one row, so its postings are formed in the batch that it is in: number the words, sort
    the numbers, cut the runs. Grouping the exploded tokens instead would move every token of the collection
    over the network. ``head`` marks one row per document; a document without tokens is a single row without term.
    With ``words`` postings of these terms only are formed, and a document without any is such a row as well.
    """
    analysed = analyze(spread(docs), doc_id, text, analyzer)
    kinds = "term string, tf int" + (", positions array<int>" if positions else "") + ", dl int, head boolean"
    schema = StructType([StructField("doc_id", analysed.schema["doc_id"].dataType), *StructType.fromDDL(kinds)])

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield posting_batch(batch, positions, words)

    return bounded_batches(analysed).mapInArrow(form, schema)


def runs(batch: pa.RecordBatch, positions: bool, in_order: bool = False, only: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """Tokens of each document ``(doc_id, tokens)`` of a batch; the document of each posting, those of one side by side; its term, tf and positions.

    With ``in_order`` the postings of a document follow the order of their terms; ``only`` lists the terms that have any.
    """
    n_tokens = pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = batch.column("tokens").flatten().dictionary_encode(null_encoding="encode")
    words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    if in_order:
        by_word = pc.sort_indices(words).to_numpy()
        words, code = words.take(pa.array(by_word)), np.argsort(by_word)[code]
    row = np.repeat(np.arange(len(n_tokens)), n_tokens)
    place = np.arange(len(row)) - (np.cumsum(n_tokens) - n_tokens)[row] if positions else row
    if only is not None:
        kept = pc.is_in(words, value_set=only, skip_nulls=True).to_numpy(zero_copy_only=False)[code]
        row, code, place = row[kept], code[kept], place[kept]
    key = row * max(len(words), 1) + code
    if positions:
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
    else:
        key = np.sort(key)
    start = np.flatnonzero(np.diff(key, prepend=-1))
    doc, word = np.divmod(key[start], max(len(words), 1))
    found = {"term": words.take(pa.array(word)).cast(pa.string()), "tf": pa.array(np.diff(start, append=len(key)), pa.int32())}
    if positions:
        found["positions"] = pa.ListArray.from_arrays(pa.array(np.append(start, len(key)), pa.int32()), pa.array(place, pa.int32()))
    return n_tokens, doc, found


def posting_batch(batch: pa.RecordBatch, positions: bool, words: pa.Array | None = None) -> pa.RecordBatch:
    """A row for each posting of the documents of a batch, and for each document without one."""
    n_tokens, doc, found = runs(batch, positions, only=words)
    empty = np.flatnonzero(np.bincount(doc, minlength=len(n_tokens)) == 0)
    row = np.concatenate([doc, empty])
    found = {name: pa.concat_arrays([column, pa.nulls(len(empty), column.type)]) for name, column in found.items()}
    ends = {"dl": pa.array(n_tokens[row], pa.int32()), "head": pa.array(np.diff(row, prepend=-1) != 0)}
    return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(row)), **found, **ends})


def build_postings(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    positions: bool = True,
    analyzer: Analyzer = tokens,
) -> DataFrame:
    """``postings(doc_id, term, tf, [positions], dl)``."""
    return posting_rows(docs, doc_id, text, positions, analyzer).where(F.col("dl") > 0).drop("head")


def doc_lengths(postings: DataFrame) -> DataFrame:
    """``(doc_id, dl)``: tokens per document."""
    return postings.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def term_stats(postings: DataFrame) -> DataFrame:
    """``(term, df, ctf)``; partial sums are formed before the shuffle, so hot terms are cheap."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))


def coll_stats(lengths: DataFrame) -> DataFrame:
    """One row ``(n_docs, sum_dl, avgdl)`` from ``(doc_id, dl)``; avgdl is 1 when there are no tokens."""
    sums = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("sum_dl"))
    return sums.withColumn(
        "avgdl", F.when(F.col("sum_dl") > 0, F.col("sum_dl") / F.col("n_docs")).otherwise(F.lit(1.0))
    )


@dataclass(frozen=True)
class TermIndex:
    """The searchable tables. ``lengths`` also lists documents without terms.

    ``stemmed`` tells that the terms are stems, so that queries have to be stemmed as well. ``documents`` is a
    second layout, ``(doc_id, doc_bucket, dl, terms)`` with a row a document, for jobs that ask for known documents.
    The numbers of buckets are given where the tables lie in folders by bucket. ``lazy`` is there where all
    of it is formed anew from the text whenever it is read; it forms the rows (``posting_rows``) of given terms, or of all.
    """

    lengths: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    stemmed: bool = False
    documents: DataFrame | None = None
    term_buckets: int = 0
    doc_buckets: int = 0
    lazy: Callable[[pa.Array | None], DataFrame] | None = None

    def stat(self, name: str) -> Column:
        """A collection statistic as a scalar subquery; it is computed once per query."""
        return self.stats.select(name).scalar()


def build_index(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    positions: bool = True,
    analyzer: Analyzer = tokens,
    stem: bool = False,
) -> TermIndex:
    """Lazy index over ``docs``; nothing runs until a query does."""
    lengths = analyze(spread(docs), doc_id, text, analyzer).select("doc_id", F.size("tokens").alias("dl"))
    analyzer = stemmed(analyzer) if stem else analyzer
    postings = build_postings(docs, doc_id, text, positions, analyzer)

    def form(words: pa.Array | None) -> DataFrame:
        return posting_rows(docs, doc_id, text, positions, analyzer, words)

    return TermIndex(lengths, postings, term_stats(postings), coll_stats(lengths), stem, lazy=form)


def narrowed(index: TermIndex, query_terms: DataFrame) -> TermIndex:
    """``index`` for jobs that ask for terms in ``query_terms`` only.

    The text of a lazy index is read once then: the postings of these terms, sent to the tasks if there are few, are
    stored with a row for each document without any, and df, ctf, lengths and statistics are counted from that table.
    """
    if index.lazy is None:
        return index
    vocab = query_terms.select("term").where("term IS NOT NULL").distinct()
    if fits(query_terms):
        rows = index.lazy(vocab.toArrow().column("term").combine_chunks())
    else:
        rows = index.lazy(None)
        kept = lookup_join(rows, vocab.withColumn("_known", F.lit(True)), "term", "left", spread_on="doc_id")
        rows = kept.where("head OR _known").withColumn("term", F.when(F.col("_known"), F.col("term"))).drop("_known")
    stored = materialize(rows, "postings")
    lengths, postings = stored.where("head").select("doc_id", "dl"), stored.where("term IS NOT NULL").drop("head")
    return replace(index, lengths=lengths, postings=postings, terms=term_stats(postings), stats=coll_stats(lengths), lazy=None)


def stemmed(analyzer: Analyzer) -> Analyzer:
    """The analyzer, followed by stemming."""
    return lambda text: stem_words(analyzer(text))


def doc_bucket(doc_id: Column, buckets: int) -> Column:
    """Directory of a document."""
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def _placed(wanted: DataFrame, index: TermIndex) -> DataFrame:
    """``wanted`` with the folder of its documents; the test, always true, lets Spark prune by them."""
    return wanted.withColumn("doc_bucket", doc_bucket(F.col("doc_id"), index.doc_buckets)).where("doc_bucket >= 0")


def document_terms(index: TermIndex, wanted: DataFrame, bound: DataFrame | None = None, words: Sequence[str] | None = None) -> DataFrame:
    """``(doc_id, term, tf, [positions], dl)`` of the documents in ``wanted``, with its other columns; of ``words`` only, if given.

    An index with a table of documents is read at their buckets only, and terms that are not asked for don't become rows; otherwise
    all postings are met.
    """
    if index.documents is None:
        postings = index.postings.drop("term_bucket")
        return lookup_join(postings if words is None else postings.where(F.col("term").isin(list(words))), wanted, "doc_id", spread_on="term", bound=bound)
    met = lookup_join(index.documents, _placed(wanted, index), ["doc_bucket", "doc_id"], bound=bound)
    terms = F.col("terms") if words is None else F.filter("terms", lambda t: t["term"].isin(list(words)))
    return met.select(*wanted.columns, "dl", F.inline(terms))


def document_lengths(index: TermIndex, wanted: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """``wanted`` with ``dl`` of its documents; ids that the index does not know are dropped."""
    if index.documents is None:
        return lookup_join(index.lengths.select("doc_id", "dl"), wanted, "doc_id", bound=bound)
    return lookup_join(index.documents.select("doc_bucket", "doc_id", "dl"), _placed(wanted, index), ["doc_bucket", "doc_id"], bound=bound).drop("doc_bucket")


def stem_postings(postings: DataFrame) -> DataFrame:
    """Postings with stemmed terms; terms of a document that share a stem are merged."""
    merged = {"tf": F.sum("tf").cast("int"), "dl": F.first("dl")}
    if "positions" in postings.columns:
        merged["positions"] = F.sort_array(F.flatten(F.collect_list("positions")))
    if "head" in postings.columns:
        merged["head"] = F.max("head")
    out = stem_column(postings).groupBy("doc_id", "term").agg(*(value.alias(name) for name, value in merged.items()))
    return out.select(*(c for c in postings.columns if c != "term_bucket"))


def term_bucket(term: Column, buckets: int) -> Column:
    """Directory of a term; documents without terms are kept apart."""
    return F.when(term.isNotNull(), F.pmod(F.xxhash64(term), F.lit(buckets))).otherwise(-1).cast("int")


def write_index(
    docs: DataFrame,
    path: str,
    mode: str = "overwrite",
    doc_id: str = "doc_id",
    text: str = "text",
    positions: bool = True,
    analyzer: Analyzer = tokens,
    stem: bool = False,
    buckets: int = TERM_BUCKETS,
) -> None:
    """Index documents into stored tables. ``mode='append'`` adds documents to an index.

    The text is read and analysed once. Postings go to a directory per term bucket, sorted by
    term so that row groups can be skipped; rebalancing splits the bucket of a term that fills
    much of the collection over many tasks and files, and needs no sampling pass over the text.
    Lengths and statistics are then taken from the stored postings. Appended documents whose id
    is in the index already are skipped, so that a repeated append changes nothing.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = docs.sparkSession
    if mode == "append":
        known = spark.read.parquet(f"{path}/lengths").select(F.col("doc_id").alias(doc_id))
        docs = lookup_join(docs, known, doc_id, "left_anti")
    rows = posting_rows(docs, doc_id, text, positions, stemmed(analyzer) if stem else analyzer)
    layout = rows.withColumn("term_bucket", term_bucket(F.col("term"), buckets)).hint("rebalance", "term_bucket")
    ordered = layout.sortWithinPartitions("term_bucket", "term", "doc_id")
    with shuffles_dropped(spark):
        ordered.write.mode(mode).option("compression", CODEC).partitionBy("term_bucket").parquet(f"{path}/postings")
        stored = spark.read.parquet(f"{path}/postings")
        stored.where("head").select("doc_id", "dl").write.mode("overwrite").parquet(f"{path}/lengths")
        terms = term_stats(stored.where(F.col("term_bucket") >= 0)).withColumn("term_bucket", term_bucket(F.col("term"), buckets))
        terms.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        stats = coll_stats(spark.read.parquet(f"{path}/lengths")).withColumn("stemmed", F.lit(stem))
        stats.write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str) -> TermIndex:
    """Open a stored index. The tables are read lazily, with column and bucket pruning."""
    lengths, postings, terms, stats = (spark.read.parquet(f"{path}/{n}") for n in ("lengths", "postings", "terms", "stats"))
    stem = bool(stats.first()["stemmed"])
    return TermIndex(lengths, postings.where(F.col("term_bucket") >= 0).drop("head"), terms, stats, stem)


def compact(spark: SparkSession, path: str, target: str, pieces: int) -> None:
    """Rewrite the postings of a stored index into ``pieces`` sorted ranges below ``target``."""
    postings = spark.read.parquet(f"{path}/postings")
    with shuffles_dropped(spark):
        (
            postings.repartitionByRange(pieces, "term_bucket", "term", "doc_id")
            .sortWithinPartitions("term_bucket", "term", "doc_id")
            .write.mode("overwrite")
            .option("compression", CODEC)
            .partitionBy("term_bucket")
            .parquet(f"{target}/postings")
        )
        for name in ("lengths", "terms", "stats"):
            spark.read.parquet(f"{path}/{name}").write.mode("overwrite").parquet(f"{target}/{name}")


def upsert(base: DataFrame, updates: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """``base`` with the rows of ``updates`` put in by ``key``; the last version wins.

    Of updates that share a key the one with the largest ``version`` counts; without such a column the
    last row does, in the order in which the updates are read. One row per key and task is shuffled.
    """
    rest = [c for c in updates.columns if c != key]
    ordered = updates.withColumn("_order", F.col(version) if version else F.monotonically_increasing_id())
    last = ordered.groupBy(key).agg(F.max_by(F.struct(*rest), "_order").alias("_last")).select(key, "_last.*")
    return lookup_join(base, last.select(key), key, "left_anti").unionByName(last.select(*updates.columns), allowMissingColumns=True)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Add ``n``: 0, 1, 2, ... in the order of ``order``, which must be a unique key.

    No single-partition window: rows are range-partitioned and sorted, stored, and each
    partition starts at the sum of the sizes before it. Only that list of sizes, one row per
    partition, is put in order in one task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    joined = marked.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn("n", F.col("_before") + place).drop("_at", "_part", "_before")


def term_dictionary(postings: DataFrame) -> DataFrame:
    """``(term, term_id, df)`` with dense ids in term order."""
    counted = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return numbered(counted, "term").select("term", F.col("n").alias("term_id"), "df")


def coverage(df: DataFrame) -> DataFrame:
    """Number of statuses and the smallest and largest id, one row."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))
