"""Joins of statuses, judgments, timelines and postings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sizing import fits, lookup_join, split_hot_join
from .postings import TermIndex, document_lengths

#: Pairs that are sent to the tasks, 16 bytes each; documents of a block at most, and at least where there are few, about.
MOST_PAIRS, BLOCK_DOCS, LEAST_DOCS = 4_000_000, 16_384, 1_024
#: Hits and terms of a user that are joined at once, on average.
HIT_BLOCK, TERM_BLOCK = 512, 256
#: Blocks of hits that a piece of a timeline meets in one task.
PART_BLOCKS = 32


def in_cohort(df: DataFrame, cohort: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows whose user is on the cohort list."""
    return lookup_join(df, cohort.select(key).distinct(), key, "left_semi", spread_on="id")


def judged_pairs(qrels: DataFrame, index: TermIndex, topics: DataFrame) -> DataFrame:
    """Judged ``(qid, doc_id, grade, dl)`` of known topics; documents without terms are skipped."""
    known = lookup_join(qrels, topics.select("qid"), "qid", "left_semi", spread_on="doc_id", bound=topics)
    return document_lengths(index, known, qrels).where(F.col("dl") > 0)


def cooccurrence(postings: DataFrame, pairs: DataFrame, bound: DataFrame | None = None, n_docs: int | None = None, max_pairs: int = MOST_PAIRS) -> DataFrame:
    """``(t1, t2, n)``: documents that contain both terms, for the given pairs only; pairs that never meet are left out.

    Documents are dealt over blocks, and in a block each term has a bitmap of its documents. A pair costs the words of a
    bitmap, or the documents of its rarer term if they are fewer; only counts per pair leave the task. Terms stand for
    themselves by 64 bits of a hash there. Up to ``max_pairs`` pairs are sent to the tasks; more of them go by rows.
    ``bound`` is a frame with at least as many rows as the pairs have different terms; ``n_docs`` is counted unless given.
    """
    wanted = pairs.select("t1", "t2").distinct()
    vocab = wanted.select(F.explode(F.array("t1", "t2")).alias("term")).distinct()
    kept = lookup_join(postings.select("doc_id", "term"), vocab, "term", "left_semi", spread_on="doc_id", bound=bound)
    if not fits(wanted, max_pairs):
        return _cooccurrence_by_rows(kept, wanted, pairs)
    hashed = wanted.select("t1", "t2", F.xxhash64("t1").alias("h1"), F.xxhash64("t2").alias("h2"))
    sent = hashed.select("h1", "h2").toArrow()
    both = pairs.sparkSession.sparkContext.broadcast((sent.column("h1").to_numpy(), sent.column("h2").to_numpy()))
    if n_docs is None:
        n_docs = postings.agg(F.approx_count_distinct("doc_id")).first()[0]
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-n_docs // BLOCK_DOCS), min(3 * cores, -(-n_docs // LEAST_DOCS)), 1)

    def count(group: pa.Table) -> pa.Table:
        first, second = both.value
        terms, term = np.unique(group.column("h").to_numpy(), return_inverse=True)
        docs, doc = np.unique(group.column("doc").to_numpy(), return_inverse=True)
        a, b = np.searchsorted(terms, first), np.searchsorted(terms, second)
        here = np.flatnonzero((terms[np.minimum(a, len(terms) - 1)] == first) & (terms[np.minimum(b, len(terms) - 1)] == second))
        n = shared_counts(term, doc, len(terms), len(docs), a[here], b[here])
        some = n > 0
        return pa.table({"h1": first[here][some], "h2": second[here][some], "n": n[some]})

    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")
    dealt = kept.select(block, F.xxhash64(F.col("doc_id"), F.lit(1)).alias("doc"), F.xxhash64("term").alias("h")).groupBy("block")
    counts = dealt.applyInArrow(count, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    return lookup_join(hashed, counts, ["h1", "h2"], bound=wanted).select("t1", "t2", "n")  # not counted by counting all documents


def shared_counts(term: np.ndarray, doc: np.ndarray, n_terms: int, n_docs: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many documents terms ``a[i]`` and ``b[i]`` both are, given all ``(term, doc)`` by number, each once or more."""
    words = -(-n_docs // 64)
    bits = np.zeros((n_terms, words), np.uint64)
    np.bitwise_or.at(bits, (term, doc >> 6), np.uint64(1) << (doc & 63).astype(np.uint64))
    df = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    swap = df[a] > df[b]
    rare, other = np.where(swap, b, a), np.where(swap, a, b)
    out = np.zeros(len(a), np.int64)
    dense = np.flatnonzero(df[rare] > words)
    for at in range(0, len(dense), step := max(1, (1 << 20) // max(words, 1))):
        part = dense[at : at + step]
        out[part] = np.bitwise_count(bits[rare[part]] & bits[other[part]]).sum(axis=1)
    order = np.unique(term.astype(np.int64) * n_docs + doc)  # each once, documents of a term side by side
    starts, listed = np.concatenate([[0], np.cumsum(df)]), order % max(n_docs, 1)
    sparse = np.flatnonzero(df[rare] <= words)
    for at in range(0, len(sparse), step := 1 << 17):
        part = sparse[at : at + step]
        size = df[rare[part]]
        ends = np.cumsum(size)
        which = np.repeat(np.arange(len(part)), size)
        docs = listed[np.arange(len(which)) + np.repeat(starts[rare[part]] - (ends - size), size)]
        hit = bits[other[part][which], docs >> 6] >> (docs & 63).astype(np.uint64) & np.uint64(1)
        out[part] = np.bincount(which, hit, len(part)).astype(np.int64)
    return out


def _cooccurrence_by_rows(kept: DataFrame, wanted: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same for pairs too many to send: each document counts its terms' partners inside its row."""
    sets = kept.groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    each = sets.select("doc_id", F.explode("terms").alias("t1"), "terms")
    partners = wanted.groupBy("t1").agg(F.collect_set("t2").alias("partners"))
    met = lookup_join(each, partners, "t1", spread_on="doc_id", bound=pairs)  # what is sent are pairs, not terms
    shared = met.select("t1", F.explode(F.array_intersect("partners", "terms")).alias("t2"))
    return shared.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"))


def shared_docs(postings: DataFrame, t1: str, t2: str) -> DataFrame:
    """Ids of the documents that contain both terms."""
    ids = postings.select("doc_id", "term")
    return ids.where(F.col("term") == t1).select("doc_id").intersect(ids.where(F.col("term") == t2).select("doc_id"))


def term_vectors(postings: DataFrame, vectors: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Postings with the vector of their term; terms without one are dropped.

    Of more vectors than ``max_rows`` those of the most frequent terms are broadcast, so that their postings, nearly all,
    stay where they are and a sum over a document is formed there. Only the postings of rarer terms are shuffled; none
    of those terms holds more than one in ``max_rows`` of the postings.
    """
    if fits(vectors, max_rows):
        return postings.join(F.broadcast(vectors), "term")
    postings = materialize(postings, "postings")
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).join(vectors.select("term"), "term", "left_semi")
    often = F.broadcast(materialize(counts.orderBy(F.desc("_n"), "term").limit(max_rows).select("term"), "often"))
    near = lookup_join(postings, vectors.join(often, "term", "left_semi"), "term", spread_on="doc_id", max_rows=max_rows)
    far = postings.join(often, "term", "left_anti").join(vectors.join(often, "term", "left_anti"), "term")
    return near.unionByName(far)


def with_timeline(hits: DataFrame, timelines: DataFrame) -> DataFrame:
    """Hits with the timeline pieces of their user: a row per hit and piece.

    A piece holds a bounded number of texts. Texts are wide, so they are never broadcast, and what is repeated for the
    join are blocks of hits: a user with many pieces is split over tasks on the piece, and a piece goes to as many tasks
    as its user has parts of PART_BLOCKS blocks. Blocks are opened only in the row that is returned.
    """
    rest = [c for c in hits.columns if c.lower() != "user_id"]
    rows = materialize(hits.where(F.col("user_id").isNotNull()).select("user_id", F.struct("user_id", *rest).alias("_hit")), "hits")
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(HIT_BLOCK)).alias("_blocks")
    users = materialize(rows.groupBy("user_id").agg(blocks), "users")
    numbered = rows.withColumn("_n", F.monotonically_increasing_id())  # of a stored table, so the same whenever it is read
    known = numbered.join(F.broadcast(users), "user_id") if fits(users) else split_hot_join(numbered, users, ["user_id"], "inner", "_n", stored=True)
    block = F.pmod(F.xxhash64("_n"), F.col("_blocks"))
    part = F.floor(F.col("_block") / F.lit(PART_BLOCKS)).alias("_part")
    packed = known.withColumn("_block", block).groupBy("user_id", part, "_block").agg(F.collect_list("_hit").alias("_hits")).drop("_block")
    pieces = lookup_join(timelines.select("user_id", "piece", F.col("text").alias("timeline")), users, "user_id", spread_on="piece")
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_blocks") - 1) / F.lit(PART_BLOCKS)))
    sent = pieces.select("user_id", "piece", "timeline", F.explode(parts).alias("_part"))
    # A few pieces make many rows, so they are dealt over all cores however small their tables are.
    tasks = 8 * hits.sparkSession.sparkContext.defaultParallelism
    met = split_hot_join(sent, packed, ["user_id", "_part"], "inner", "piece", tasks=tasks)
    return met.select(F.inline("_hits"), "piece", "timeline")


def background_terms(hits: DataFrame, timeline_terms: DataFrame) -> DataFrame:
    """``(id, term, tf)`` of the timeline of the user of each hit; ``timeline_terms`` has one row per user and term.

    Each hit of a user meets each of its terms, so blocks of both are joined, and opened only in the row that is returned.
    Rows of a term follow each other within a block of hits, and the same hits follow for the next term: what is written
    takes a fraction of its rows' size.
    """
    users = _blocks(hits.select("user_id", "id"), HIT_BLOCK, "ids")
    terms = _blocks(timeline_terms.select("user_id", "term", "tf"), TERM_BLOCK, "terms")
    met = split_hot_join(terms, users.withColumnRenamed("block", "_hits"), ["user_id"], "inner", "block")
    # A few rows make many, so they are dealt over all cores however small their tables are.
    met = met.repartition(8 * hits.sparkSession.sparkContext.defaultParallelism, "user_id", "block", "_hits")
    return met.select("ids", F.inline("terms")).select(F.inline("ids"), "term", "tf")


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``(user_id, block, <name>)``: the other columns of a user's rows in arrays of about ``size``, however often a row repeats."""
    rest = [c for c in rows.columns if c != "user_id"]
    rows = materialize(rows.where("user_id IS NOT NULL"), name)
    most = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-most // size))))
    return dealt.groupBy("user_id", "block").agg(F.collect_list(F.struct(*rest)).alias(name))


def reply_roots(df: DataFrame, id_col: str = "id", parent: str = "in_reply_to_status_id") -> DataFrame:
    """``(id, root_id, depth)``: topmost known ancestor of every status and the steps to it.

    Pointer doubling: after round r a status points 2^r steps up, so the number of joins is the
    logarithm of the longest chain. Statuses that reached their root take no part in further
    rounds. No chain is longer than there are replies, so what is open after the logarithm of their number
    is on a cycle, or leads to one; it has no root and is reported with NULL.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(parent).alias("up"))
    known = own.select(F.col("id").alias("up"), F.lit(True).alias("_known"))
    linked = split_hot_join(own, known, ["up"], "left", "id")
    state = materialize(
        linked.select(
            "id",
            F.when(F.col("_known"), F.col("up")).otherwise(F.col("id")).alias("root_id"),
            F.when(F.col("_known"), 1).otherwise(0).cast("bigint").alias("depth"),
            (~F.coalesce("_known", F.lit(False))).alias("done"),
        ),
        "replies",
    )
    finished, open_rows = [state.where("done")], state.where(~F.col("done"))
    for _ in range(open_rows.count().bit_length() + 1):
        if open_rows.isEmpty():
            break
        every = open_rows
        for part in finished:
            every = every.unionByName(part)
        step = every.select(
            F.col("id").alias("root_id"), F.col("root_id").alias("_next"), F.col("depth").alias("_more"),
            F.col("done").alias("_top"),
        )
        if fits(step):
            moved = open_rows.join(F.broadcast(step), "root_id")
        else:
            moved = split_hot_join(open_rows, step, ["root_id"], "inner", "id")
        moved = materialize(
            moved.select(
                "id", F.col("_next").alias("root_id"), (F.col("depth") + F.col("_more")).alias("depth"), F.col("_top").alias("done")
            ),
            "replies",
        )
        finished.append(moved.where("done"))
        open_rows = moved.where(~F.col("done"))
    out = open_rows.select("id", F.lit(None).cast("bigint").alias("root_id"), F.lit(None).cast("bigint").alias("depth"))
    for part in finished:
        out = out.unionByName(part.drop("done"))
    return out


def reply_chain(df: DataFrame, starts: DataFrame, id_col: str = "id", parent: str = "in_reply_to_status_id") -> DataFrame:
    """``(start_id, id, steps)``: each start and all its known ancestors; the root has the most steps.

    A round knows the ancestors up to some distance and links that lead that far; three joins along the links take each
    chain to four times the distance, a fourth makes the links of the next round. So the tables that are written are
    the logarithm of the longest chain in number. A popular status that many chains pass is split over tasks. A chain that
    runs into a cycle has each status once, at its least distance; nothing new is found there, which ends the rounds.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(parent).alias("up"))
    known = own.where(F.col("id").isNotNull()).select("id").distinct()
    links = materialize(own.join(known.withColumnRenamed("id", "up"), "up", "left_semi").distinct(), "links")
    first = starts.select(F.col(id_col).alias("id")).distinct().join(known, "id", "left_semi")
    reached = materialize(first.select(F.col("id").alias("start_id"), "id", F.lit(0).cast("bigint").alias("steps")), "chain")
    n, stride = reached.count(), 1
    while not links.isEmpty():
        small = fits(links)

        def along(rows: DataFrame, at: str, spread_on: str, links: DataFrame = links, small: bool = small) -> DataFrame:
            """``rows`` with column ``at`` replaced by where the links lead from there."""
            step = links.select(F.col("id").alias(at), F.col("up").alias("_to"))
            met = rows.join(F.broadcast(step), at) if small else split_hot_join(rows, step, [at], "inner", spread_on)
            return met.withColumn(at, F.col("_to")).select(*rows.columns)

        every = step = reached
        for _ in range(3):
            step = along(step, "id", "start_id").withColumn("steps", F.col("steps") + stride)
            every = every.unionByName(step)
        reached = materialize(every.groupBy("start_id", "id").agg(F.min("steps").alias("steps")), "chain")
        before, n = n, reached.count()
        if n == before:
            break
        further = links
        for _ in range(3):
            further = along(further, "up", "id")
        links, stride = materialize(further.distinct(), "links"), 4 * stride
    return reached
