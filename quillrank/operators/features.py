"""Query-document features as grouped aggregates over one join of pairs with postings."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import count_substr, tokens
from ..session import bounded_batches, materialize
from ..sizing import fits, lookup_join
from .joins import cooccurrence, judged_pairs
from .postings import Analyzer, TermIndex, document_lengths, document_terms, narrowed
from .ranking import analyze_topics, match_terms, matching_pairs, query_term_counts, with_term_stats

# The default feature sets, in output order.
WEB_FEATURES = (
    "UnigramsFeatureExtractor",
    "UnorderedSequentialPairs6", "UnorderedSequentialPairs8", "UnorderedSequentialPairs10",
    "OrderedSequentialPairs6", "OrderedSequentialPairs8", "OrderedSequentialPairs10",
    "MatchingTermCount", "QueryLength", "SumMatchingTf", "SumTermFrequency", "BM25Feature",
    "TFIDF", "UniqueQueryTerms", "DocSize", "AvgICTF", "AvgIDF", "SimplifiedClarityScore",
    "PMIFeature", "AvgSCQ",
)
STATUS_FEATURES = WEB_FEATURES + (
    "TwitterLinkCount", "TwitterFollowerCount", "TwitterFriendCount", "IsTweetReply", "TwitterHashtagCount",
)

PAIR_KINDS = {
    "OrderedSequentialPairs": "ordered_next",
    "UnorderedSequentialPairs": "unordered_next",
    "OrderedAllPairs": "ordered_all",
    "UnorderedQueryTokenPairs": "unordered_all",
}

SDM_WEIGHTS = (0.5, 0.2, 0.3)
SDM_WINDOW = 8
#: Terms of queries that are looked for inside the rows of documents, as a set that is part of the plan.
MOST_WORDS = 20_000
#: Pairs that a task sums up, at most about, where every document meets every query it shares a term with.
PAIRS_A_TASK = 500_000


@dataclass(frozen=True)
class Feature:
    """A feature to extract.

    ``level`` says what ``value`` is built from: ``match`` (an aggregate over the matched query
    terms of a pair, with columns tf, dl, qtf, df, ctf), ``pair`` (position pairs), or ``row``
    (an expression over query columns qlen, n_unique, avg_idf, avg_scq, clarity, pmi, the
    matched aggregates n_match, sum_tf, the document length dl, and document attributes).
    """

    name: str
    level: str
    value: Callable[[TermIndex], Column] | None = None
    finish: Callable[[Column], Column] = field(default=lambda c: c)
    kind: str = ""
    gap: int = 0


_registry: dict[str, Callable[[dict], Feature]] = {}


def register_feature(name: str, make: Callable[[dict], Feature]) -> None:
    """Add a feature by name. ``make`` gets the parameters of the feature set entry."""
    _registry[name] = make


def _row(name: str, value: Callable[[], Column]) -> None:
    register_feature(name, lambda params: Feature(name, "row", lambda index: value()))


def _match(name: str, value: Callable[[TermIndex], Column], finish: Callable[[Column], Column] = lambda c: c) -> None:
    register_feature(name, lambda params: Feature(name, "match", value, finish))


def _idf(index: TermIndex) -> Column:
    return F.log(1 + (index.stat("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _tfidf_idf(index: TermIndex) -> Column:
    return 1 + F.log(index.stat("n_docs") / (F.col("df") + 1))


_row("QueryLength", lambda: F.col("qlen"))
_row("UniqueQueryTerms", lambda: F.col("n_unique"))
_row("MatchingTermCount", lambda: F.col("n_match"))
for _name in ("SumMatchingTf", "SumTermFrequency", "UnigramsFeatureExtractor"):
    _row(_name, lambda: F.col("sum_tf"))
_row("DocSize", lambda: F.col("dl"))
_row("AvgIDF", lambda: F.col("avg_idf"))
_row("AvgSCQ", lambda: F.col("avg_scq"))
_row("SimplifiedClarityScore", lambda: F.col("clarity"))
_row("PMIFeature", lambda: F.col("pmi"))
_match("AvgICTF", lambda index: F.sum(F.log(F.col("dl") / F.col("tf"))), lambda c: c / F.col("qlen"))
_match(
    "TFIDF",
    lambda index: F.sum(F.col("qtf") * F.sqrt("tf") * _tfidf_idf(index) * _tfidf_idf(index)),
    lambda c: c * F.col("n_match") / F.col("qlen"),
)


def _bm25(params: dict) -> Feature:
    k1, b = float(params.get("k1", 1.2)), float(params.get("b", 0.75))

    def value(index: TermIndex) -> Column:
        norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / index.stat("avgdl"))
        return F.sum(_idf(index) * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + norm))

    return Feature("BM25Feature", "match", value)


register_feature("BM25Feature", _bm25)
for _name, _kind in PAIR_KINDS.items():
    register_feature(
        _name, lambda params, n=_name, k=_kind: Feature(f"{n}{int(params['gapSize'])}", "pair", kind=k, gap=int(params["gapSize"]))
    )
register_feature("SDM", lambda params: Feature("SDM", "sdm", gap=SDM_WINDOW))
_row("TwitterHashtagCount", lambda: count_substr("text", "#"))
register_feature(
    "TwitterLinkCount",
    lambda params: Feature("TwitterLinkCount", "row", lambda index: count_substr("text", params.get("pattern", "http://"))),
)
_row("IsTweetReply", lambda: F.col("in_reply_to_status_id").isNotNull().cast("int"))
_row("TwitterFollowerCount", lambda: F.coalesce("followers_count", F.lit(0)))
_row("TwitterFriendCount", lambda: F.coalesce("friends_count", F.lit(0)))


def feature(name: str, params: dict | None = None) -> Feature | None:
    """The feature of that name, with the gap of a pair feature as suffix; None if unknown."""
    if name in _registry and (name not in PAIR_KINDS or params):
        return _registry[name](params or {})
    with_gap = re.fullmatch(r"([A-Za-z]+?)(\d+)", name)
    if with_gap and with_gap[1] in PAIR_KINDS:
        return _registry[with_gap[1]]({"gapSize": int(with_gap[2])})
    return None


def load_feature_set(text: str) -> list[Feature]:
    """Features of a JSON set ``{extractors: [{name, params}]}``; unknown names are skipped.

    Keys and plain words may stand without quotes. Order is kept and repeats are allowed.
    """
    quoted = re.sub(r'"[^"]*"|([A-Za-z_]\w*)', lambda m: f'"{m[1]}"' if m[1] else m[0], text)
    entries = json.loads(quoted)["extractors"]
    found = (feature(entry["name"], entry.get("params")) for entry in entries)
    return [f for f in found if f is not None]


def _features(names: Sequence[str | Feature]) -> list[Feature]:
    out = []
    for item in names:
        found = feature(item) if isinstance(item, str) else item
        if found is None:
            raise ValueError(f"unknown feature {item!r}")
        out.append(found)
    return out


def column_names(features: Sequence[Feature]) -> list[str]:
    """Output columns; a repeated feature gets a number."""
    seen: dict[str, int] = {}
    out = []
    for f in features:
        seen[f.name] = seen.get(f.name, 0) + 1
        out.append(f.name if seen[f.name] == 1 else f"{f.name}_{seen[f.name]}")
    return out


def pmi(query_terms: DataFrame, index: TermIndex, bound: DataFrame | None = None) -> DataFrame:
    """``(qid, pmi)``: mean over term pairs of ``ln(n12 / (df1 df2))``; 0 for a single term."""
    terms = query_terms.select("qid", "term", "df")
    listed = terms.groupBy("qid").agg(F.sort_array(F.collect_set(F.struct("term", "df"))).alias("terms"))
    pairs = listed.select("qid", F.posexplode("terms").alias("i", "x"), "terms").select(
        "qid", "x", F.explode(F.slice("terms", F.col("i") + 2, F.size("terms"))).alias("y")
    )
    flat = pairs.select("qid", F.col("x.term").alias("t1"), F.col("y.term").alias("t2"), (F.col("x.df") * F.col("y.df").cast("double")).alias("dd"))
    flat = materialize(flat, "pairs")
    counts = cooccurrence(index.postings, flat, bound, index.stats.first()["n_docs"])
    scored = flat.join(counts, ["t1", "t2"], "left")
    return scored.groupBy("qid").agg(F.avg(F.coalesce(F.log(F.col("n") / F.col("dd")), F.lit(0.0))).alias("pmi"))


def query_features(query_tokens: DataFrame, index: TermIndex, with_pmi: bool = True) -> DataFrame:
    """``(qid, qlen, n_unique, avg_idf, avg_scq, clarity, pmi)``: computed once per query."""
    counts = query_term_counts(query_tokens)
    vocab = counts.select("term").distinct()
    known = index.terms.select("term", "df", "ctf").join(F.broadcast(vocab) if fits(query_tokens) else vocab, "term", "left_semi")
    terms = counts.join(known, "term", "left").fillna(0, ["df", "ctf"])
    sized = terms.withColumn("qlen", F.sum("qtf").over(Window.partitionBy("qid")))
    p = F.col("qtf") / F.col("qlen")
    idf = _idf(index)
    out = sized.groupBy("qid").agg(
        F.sum("qtf").alias("qlen"),
        F.count(F.lit(1)).alias("n_unique"),
        (F.sum(F.col("qtf") * idf) / F.sum("qtf")).alias("avg_idf"),
        (F.coalesce(F.sum(F.when(F.col("ctf") > 0, F.col("qtf") * (1 + F.log(F.col("ctf") * idf)))), F.lit(0.0)) / F.sum("qtf")).alias("avg_scq"),
        F.coalesce(F.sum(F.when(F.col("ctf") > 0, p * F.log(p / (F.col("ctf") / index.stat("sum_dl"))))), F.lit(0.0)).alias("clarity"),
    )
    if not with_pmi:
        return out.withColumn("pmi", F.lit(None).cast("double"))
    return out.join(pmi(terms, index, query_tokens), "qid", "left").withColumn("pmi", F.coalesce("pmi", F.lit(0.0)))


def query_pairs(query_tokens: DataFrame, merge_repeats: bool = False, adjacent: bool = False) -> DataFrame:
    """``(qid, t1, t2, ordered_next, unordered_next, ordered_all, unordered_all)``.

    Says how often a document pair "t1 before t2" counts for each kind of feature. A pair that
    matches a query pair in both directions counts twice in the unordered kinds. For
    ``ordered_all`` a repeated query token keeps the partners of its last place that has any;
    ``merge_repeats`` uses the partners of all its places. With ``adjacent`` only pairs of neighbours are
    formed, as many as the query has tokens, and the two kinds of all pairs are not to be used.
    """
    listed = query_tokens.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).getField("term").alias("q"))
    places = listed.select("qid", "q", F.posexplode("q").alias("i", "a")).where(F.col("i") < F.size("q") - 1)
    last = F.max("i").over(Window.partitionBy("qid", "a"))
    ahead = places.withColumn("last", last).select(
        "qid", "a", "i", "last", F.posexplode(F.slice("q", F.col("i") + 2, F.lit(1) if adjacent else F.size("q"))).alias("j", "b")
    )
    pairs = ahead.groupBy("qid", "a", "b").agg(
        F.max(F.col("j") == 0).cast("int").alias("next"),
        (F.lit(1) if merge_repeats else F.max(F.col("i") == F.col("last")).cast("int")).alias("kept"),
    )
    zero = F.lit(0)
    forward = pairs.select(
        "qid", F.col("a").alias("t1"), F.col("b").alias("t2"), F.col("next").alias("ordered_next"),
        F.col("next").alias("unordered_next"), F.col("kept").alias("ordered_all"), F.lit(1).alias("unordered_all"),
    )
    backward = pairs.select(
        "qid", F.col("b").alias("t1"), F.col("a").alias("t2"), zero.alias("ordered_next"),
        F.col("next").alias("unordered_next"), zero.alias("ordered_all"), F.lit(1).alias("unordered_all"),
    )
    kinds = ("ordered_next", "unordered_next", "ordered_all", "unordered_all")
    return forward.unionByName(backward).groupBy("qid", "t1", "t2").agg(*(F.sum(k).cast("int").alias(k) for k in kinds))


def pair_matches(pairs: DataFrame, query_tokens: DataFrame, index: TermIndex, most: bool = False) -> DataFrame:
    """Matched query terms of the pairs: ``(qid, doc_id, term, qtf, tf, positions, dl, df, ctf)``.

    With a table of documents the pairs' documents are read and keep their query's terms; otherwise
    the postings of all query terms are, and keep the pairs. If the pairs are ``most`` of those that match, the
    matches are formed first, so that no row is sent for a term of the query that the document has not.
    """
    counts = query_term_counts(query_tokens)
    if most:
        known = with_term_stats(counts.withColumnRenamed("qtf", "weight"), index).withColumnRenamed("weight", "qtf")
        matches = match_terms(index.postings, known, bound=query_tokens).drop("term_bucket")
        return matches.join(pairs.select("qid", "doc_id"), ["qid", "doc_id"])
    if index.documents is not None:
        known = with_term_stats(counts.withColumnRenamed("qtf", "weight"), index).withColumnRenamed("weight", "qtf").drop("term_bucket")
        vocab = counts.select("term").distinct()
        words = [r["term"] for r in vocab.collect()] if fits(vocab, MOST_WORDS) else None
        found = document_terms(index, pairs.select("qid", "doc_id"), words=words)
        return lookup_join(found, known, ["qid", "term"], spread_on="doc_id", bound=query_tokens)
    wanted = lookup_join(pairs.select("qid", "doc_id"), counts, "qid", spread_on="doc_id", bound=query_tokens)
    vocab = counts.select("term").distinct()
    # A stored index also has the directory of each term, so that a scan reads only those of the query.
    place = [c for c in ("term_bucket",) if c in index.terms.columns and c in index.postings.columns]
    stats = index.terms.select("term", "df", "ctf", *place).join(F.broadcast(vocab) if fits(query_tokens) else vocab, "term", "left_semi")
    wanted = lookup_join(wanted, stats, "term", spread_on="doc_id", bound=query_tokens)
    postings = index.postings if place else index.postings.drop("term_bucket")
    return lookup_join(postings, wanted, ["doc_id", "term", *place]).drop(*place)


def token_sequence() -> Column:
    """Aggregate: query tokens of a document as (pos, term), in text order; no longer than the document."""
    return F.sort_array(
        F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("term").alias("term")))))
    )


def position_pairs(df: DataFrame, gap: int, sequence: str = "seq") -> DataFrame:
    """Explode ``(t1, t2, distance)`` with ``0 < pos2 - pos1 <= gap``.

    Positions are distinct, so only the next ``gap`` entries of the sequence can be close
    enough; the work is linear in the length of the document.
    """
    seq = F.col(sequence)
    near = F.flatten(
        F.transform(
            seq,
            lambda x, i: F.transform(
                F.filter(F.slice(seq, i + 2, gap), lambda y: y["pos"] - x["pos"] <= gap),
                lambda y: F.struct(x["term"].alias("t1"), y["term"].alias("t2"), (y["pos"] - x["pos"]).alias("distance")),
            ),
        )
    )
    rest = [c for c in df.columns if c != sequence]
    return df.select(*rest, F.explode(near).alias("_pair")).select(*rest, "_pair.*")


def count_pairs(matches: DataFrame, weights: DataFrame, features: Sequence[Feature], sums: Sequence[Column] = ()) -> DataFrame:
    """``(qid, doc_id, <sums>, <one column per pair feature>)``; all gaps are counted in one pass, with other ``sums`` of the matches.

    Weights of proven size are sent to the tasks, and the close positions of a batch of documents are counted there as
    arrays; they never become rows. Beyond that size they do, and meet the weights in a join.
    """
    gap = max(f.gap for f in features)
    if not fits(weights):
        sequences = matches.groupBy("qid", "doc_id").agg(token_sequence().alias("seq"))
        weighed = lookup_join(position_pairs(sequences, gap), weights, ["qid", "t1", "t2"], spread_on="doc_id")
        near = {f.name: F.sum(F.when(F.col("distance") <= f.gap, F.col(f.kind)).otherwise(0)).alias(f.name) for f in features}
        counted = weighed.groupBy("qid", "doc_id").agg(*near.values())
        return matches.groupBy("qid", "doc_id").agg(*sums).join(counted, ["qid", "doc_id"], "left") if sums else counted
    places = matches.groupBy("qid", "doc_id").agg(*sums, F.collect_list(F.struct("term", "positions")).alias("places"))
    schema = StructType([*places.schema.fields[:-1], *(StructField(f.name, LongType()) for f in features)])
    wanted, columns = PairWeights.of(weights.toArrow()), [(f.name, f.kind, f.gap) for f in features]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pair_batch(batch, wanted, columns, gap)

    return bounded_batches(places).mapInArrow(count, schema)


@dataclass(frozen=True)
class PairWeights:
    """How often "t1 before t2" counts for each kind, by ``(qid, t1, t2)`` as one number, in ascending order of it."""

    qids: pa.Array
    terms: pa.Array
    keys: np.ndarray
    kinds: dict[str, np.ndarray]

    @staticmethod
    def of(weights: pa.Table) -> PairWeights:
        names = ("qid", "t1", "t2")
        qid, t1, t2 = (pa.array(weights.column(n).combine_chunks()) for n in names)
        qids, terms = pc.unique(qid), pc.unique(pa.concat_arrays([t1, t2]))
        q, a, b = (pc.index_in(v, value_set=s).to_numpy(zero_copy_only=False).astype(np.int64) for v, s in ((qid, qids), (t1, terms), (t2, terms)))
        keys = (q * len(terms) + a) * len(terms) + b
        order = np.argsort(keys)
        kinds = {n: weights.column(n).to_numpy()[order] for n in weights.column_names if n not in names}
        return PairWeights(qids, terms, keys[order], kinds)


def _known(values: pa.Array, among: pa.Array) -> np.ndarray:
    """Numbers of the values among others, -1 for those that are not there."""
    return pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy().astype(np.int64)


def token_places(places: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and number among ``terms`` of each token of rows of terms with positions, in the order of the text."""
    n_terms = pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64)
    term, positions = places.flatten().flatten()
    n_places = pc.list_value_length(positions).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = term.dictionary_encode()
    by_word = pc.sort_indices(coded.dictionary).to_numpy()
    code = np.repeat(np.argsort(by_word)[coded.indices.to_numpy()], n_places)
    row = np.repeat(np.repeat(np.arange(len(places)), n_terms), n_places)
    pos = positions.flatten().to_numpy().astype(np.int64)
    order = np.lexsort((code, pos, row))
    row, pos, code = row[order], pos[order], code[order]
    return row, pos, _known(coded.dictionary.take(pa.array(by_word)), terms)[code]


def pair_batch(batch: pa.RecordBatch, weights: PairWeights, columns: Sequence[tuple[str, str, int]], gap: int) -> pa.RecordBatch:
    """Rows ``(qid, doc_id, ..., places)`` with counts of ``columns`` (name, kind, gap) for their ``places``, terms with positions."""
    row, pos, word = token_places(batch.column("places"), weights.terms)
    query = _known(batch.column("qid"), weights.qids)[row]
    found = [(np.empty(0, np.int64),) * 3]
    for step in range(1, gap + 1):
        distance = pos[step:] - pos[:-step]
        at = np.flatnonzero((row[step:] == row[:-step]) & (distance <= gap) & (word[step:] >= 0) & (word[:-step] >= 0) & (query[step:] >= 0))
        key = (query[at] * len(weights.terms) + word[at]) * len(weights.terms) + word[at + step]
        place = np.searchsorted(weights.keys, key)
        hit = np.flatnonzero(weights.keys[np.minimum(place, len(weights.keys) - 1)] == key) if len(weights.keys) else place
        found.append((row[at[hit]], distance[at[hit]], place[hit]))
    rows, distances, which = (np.concatenate(part) for part in zip(*found))
    out = {name: batch.column(name) for name in batch.schema.names if name != "places"}
    for name, kind, most in columns:
        near = distances <= most
        out[name] = pa.array(np.bincount(rows[near], weights.kinds[kind][which[near]], batch.num_rows).astype(np.int64))
    return pa.RecordBatch.from_pydict(out)


def document_pairs(batch: pa.RecordBatch, weights: PairWeights, columns: Sequence[tuple[str, str, int]], gap: int) -> pa.RecordBatch:
    """Rows ``(doc_id, places)`` to ``(qid, doc_id, ...)`` with counts of ``columns`` for each query that has a close pair in the document.

    The close positions of a document are found once for all queries. Where positions repeat, as the rows of several documents
    share an id, what is close depends on the terms of the query, and its own sequence of tokens is formed.
    """
    row, pos, word = token_places(batch.column("places"), weights.terms)
    n_words, n_queries = max(len(weights.terms), 1), max(len(weights.qids), 1)
    again = np.unique(row[1:][(row[1:] == row[:-1]) & (pos[1:] == pos[:-1])])
    plain = ~np.isin(row, again) & (word >= 0)
    by_pair = np.argsort(weights.keys % n_words**2, kind="stable")
    pairs = weights.keys[by_pair] % n_words**2
    groups, distances, which = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    r, p, w = row[plain], pos[plain], word[plain]
    for step in range(1, gap + 1):
        distance = p[step:] - p[:-step]
        at = np.flatnonzero((r[step:] == r[:-step]) & (distance <= gap))
        key = w[at] * n_words + w[at + step]
        first = np.searchsorted(pairs, key)
        n = np.searchsorted(pairs, key, "right") - first
        met = by_pair[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)]
        at = np.repeat(at, n)
        groups.append(r[at] * n_queries + weights.keys[met] // n_words**2)
        distances.append(distance[at])
        which.append(met)
    query, pair = np.divmod(weights.keys, n_words**2)
    asked = np.unique(np.concatenate([pair // n_words, pair % n_words]) * n_queries + np.tile(query, 2))  # queries of each term
    for one in again:
        own = np.flatnonzero((row == one) & (word >= 0))
        first = np.searchsorted(asked, word[own] * n_queries)
        n = np.searchsorted(asked, (word[own] + 1) * n_queries) - first
        q = asked[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)] % n_queries
        order = np.argsort(q, kind="stable")
        q, own = q[order], np.repeat(own, n)[order]
        for step in range(1, gap + 1):
            distance = pos[own[step:]] - pos[own[:-step]]
            at = np.flatnonzero((q[step:] == q[:-step]) & (distance <= gap))
            key = (q[at] * n_words + word[own[at]]) * n_words + word[own[at + step]]
            place = np.searchsorted(weights.keys, key)
            hit = np.flatnonzero(weights.keys[np.minimum(place, len(weights.keys) - 1)] == key) if len(weights.keys) else place
            groups.append(one * n_queries + q[at[hit]])
            distances.append(distance[at[hit]])
            which.append(place[hit])
    group, index = np.unique(np.concatenate(groups), return_inverse=True)
    distance, met = np.concatenate(distances), np.concatenate(which)
    doc, qid = np.divmod(group, n_queries)
    out = {"qid": weights.qids.take(pa.array(qid)), "doc_id": batch.column("doc_id").take(pa.array(doc))}
    for name, kind, most in columns:
        near = distance <= most
        out[name] = pa.array(np.bincount(index[near], weights.kinds[kind][met[near]], len(group)).astype(np.int64))
    return pa.RecordBatch.from_pydict(out)


def matched_pairs(index: TermIndex, query_tokens: DataFrame, n_topics: int, sums: Sequence[Column], weights: DataFrame | None, features: Sequence[Feature]) -> DataFrame:
    """``(qid, doc_id, dl, <sums>, <one column per pair feature>)`` of each query with the documents that hold any of its terms.

    Query tokens and ``weights`` are of proven size. The postings of the queries' terms are dealt by document before they meet the
    queries, many of which ask for each of them: all matches of a document are then summed up where they are formed, in tasks
    of about PAIRS_A_TASK pairs. Documents without an id match, but nothing is known of them.
    """
    counts = query_term_counts(query_tokens)
    known = with_term_stats(counts.withColumnRenamed("qtf", "weight"), index).withColumnRenamed("weight", "qtf").where(F.length("term") > 0)
    keys = [c for c in ("term_bucket", "term") if c in known.columns and c in index.postings.columns]
    kept = index.postings.join(F.broadcast(known.select(*keys).distinct()), keys, "left_semi") if len(keys) > 1 else index.postings
    cores = query_tokens.sparkSession.sparkContext.defaultParallelism
    tasks = max(3 * cores, -(-index.stats.first()["n_docs"] * n_topics // PAIRS_A_TASK))
    dealt = kept.repartition(tasks, "doc_id")
    met = dealt.drop("positions").join(F.broadcast(known), keys).groupBy("qid", "doc_id").agg(F.first("dl").alias("dl"), *sums)
    out = met.select("qid", "doc_id", "dl", *(F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in met.columns[3:]))
    if not features:
        return out
    gap, wanted, columns = max(f.gap for f in features), PairWeights.of(weights.toArrow()), [(f.name, f.kind, f.gap) for f in features]
    docs = dealt.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_list(F.struct("term", "positions")).alias("places"))
    schema = StructType([weights.schema["qid"], docs.schema["doc_id"], *(StructField(f.name, LongType()) for f in features)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield document_pairs(batch, wanted, columns, gap)

    return out.join(bounded_batches(docs).mapInArrow(count, schema), ["qid", "doc_id"], "left")


def sequential_dependence(matches: DataFrame, weights: DataFrame, window: int = SDM_WINDOW) -> DataFrame:
    """``(qid, doc_id, sdm_terms, sdm_ordered, sdm_window)``: sums of ``ln(count + 1)``.

    The part that does not depend on counts is added per pair by ``sdm_value``.
    """
    grouped = matches.groupBy("qid", "doc_id").agg(
        F.sum(F.log(F.col("tf") + F.lit(1.0))).alias("sdm_terms"), token_sequence().alias("seq")
    )
    adjacent = weights.where(F.col("ordered_next") > 0).select("qid", "t1", "t2")
    directed = adjacent.select("qid", "t1", "t2", F.col("t1").alias("a"), F.col("t2").alias("b"), F.lit(1).alias("same")).unionByName(
        adjacent.select("qid", F.col("t2").alias("t1"), F.col("t1").alias("t2"), F.col("t1").alias("a"), F.col("t2").alias("b"), F.lit(0).alias("same"))
    )
    near = position_pairs(grouped.select("qid", "doc_id", "seq"), window)
    met = lookup_join(near, directed, ["qid", "t1", "t2"], spread_on="doc_id")
    counts = met.groupBy("qid", "doc_id", "a", "b").agg(
        F.sum(F.when(F.col("distance") == 1, F.col("same")).otherwise(0)).alias("ordered"), F.count(F.lit(1)).alias("near")
    )
    pairs = counts.groupBy("qid", "doc_id").agg(
        F.sum(F.log(F.col("ordered") + F.lit(1.0))).alias("sdm_ordered"), F.sum(F.log(F.col("near") + F.lit(1.0))).alias("sdm_window")
    )
    return grouped.select("qid", "doc_id", "sdm_terms").join(pairs, ["qid", "doc_id"], "left")


def sdm_value(lambdas: Sequence[float] = SDM_WEIGHTS) -> Column:
    """Weighted log scores from the sums, the document length and the number of query terms and pairs."""
    size = F.log(F.col("dl") + F.lit(1.0))
    parts = (("sdm_terms", "n_unique"), ("sdm_ordered", "n_adjacent"), ("sdm_window", "n_adjacent"))
    total = F.lit(0.0)
    for weight, (name, n) in zip(lambdas, parts):
        total = total + F.lit(weight) * (F.coalesce(name, F.lit(0.0)) - F.coalesce(n, F.lit(0)) * size)
    return total


def extract_features(
    pairs: DataFrame,
    index: TermIndex,
    topics: DataFrame,
    names: Sequence[str | Feature] = WEB_FEATURES,
    analyzer: Analyzer = tokens,
    most: bool = False,
) -> DataFrame:
    """``pairs`` with one DOUBLE column per feature; ``most`` tells that they are most of the pairs that match.

    ``pairs`` has qid, doc_id and whatever else should be kept; status features need the status
    columns in it. The matched query terms are found by one join with the postings, and all
    document-level features come from one aggregate over it.
    """
    features = _features(names)
    query_tokens = analyze_topics(topics, analyzer, index.stemmed)
    index = narrowed(index, query_tokens)
    matches = pair_matches(pairs, query_tokens, index, most)
    aggregates, paired, weights = _parts(features, query_tokens, index)
    summed = count_pairs(matches, weights, paired, aggregates) if paired else matches.groupBy("qid", "doc_id").agg(*aggregates)
    out = pairs.join(summed, ["qid", "doc_id"], "left")
    return _finished(out, pairs.columns, features, query_tokens, index, topics, weights, matches, pairs)


def _parts(features: Sequence[Feature], query_tokens: DataFrame, index: TermIndex) -> tuple[list[Column], list[Feature], DataFrame | None]:
    """Aggregates of the matches of a pair, the different pair features, and the weights that those and SDM need."""
    aggregates = [F.count(F.lit(1)).alias("n_match"), F.sum("tf").alias("sum_tf")]
    aggregates += [f.value(index).alias(f"_m{i}") for i, f in enumerate(features) if f.level == "match"]
    paired = [f for f in features if f.level == "pair"]
    weights = None
    if paired or any(f.level == "sdm" for f in features):
        weights = query_pairs(query_tokens, adjacent=not any(f.kind in ("ordered_all", "unordered_all") for f in paired))
    return aggregates, list({f.name: f for f in paired}.values()), weights


def _finished(
    out: DataFrame, kept: Sequence[str], features: Sequence[Feature], query_tokens: DataFrame, index: TermIndex, topics: DataFrame,
    weights: DataFrame | None, matches: DataFrame | None, bound: DataFrame | None = None,
) -> DataFrame:
    """Columns ``kept`` and the features, from pairs with their sums; ``matches`` are needed for SDM only.

    ``bound`` is a frame with at least as many rows, so that the pairs are not summed up once more to be counted.
    """
    out = out.fillna(0, ["n_match", "sum_tf", *dict.fromkeys(f.name for f in features if f.level == "pair")])
    wants_pmi = any(f.name == "PMIFeature" for f in features)
    out = lookup_join(out, query_features(query_tokens, index, wants_pmi), "qid", spread_on="doc_id", bound=topics)
    if "dl" not in kept:
        out = document_lengths(index, out, bound)

    if any(f.level == "sdm" for f in features):
        adjacent = weights.where(F.col("ordered_next") > 0).groupBy("qid").agg(F.count(F.lit(1)).alias("n_adjacent"))
        out = lookup_join(out, adjacent, "qid", "left", spread_on="doc_id", bound=topics)
        out = out.join(sequential_dependence(matches, weights), ["qid", "doc_id"], "left")

    values = []
    for i, (f, name) in enumerate(zip(features, column_names(features))):
        if f.level == "match":
            value = f.finish(F.coalesce(F.col(f"_m{i}"), F.lit(0.0)))
        elif f.level == "pair":
            value = F.col(f.name)
        elif f.level == "sdm":
            value = sdm_value()
        else:
            value = f.value(index)
        values.append(value.cast("double").alias(name))
    return out.select(*[F.col(c) for c in kept], *values)


def extract_judged(
    qrels: DataFrame, index: TermIndex, topics: DataFrame, names: Sequence[str | Feature] = WEB_FEATURES,
    docs: DataFrame | None = None, analyzer: Analyzer = tokens,
) -> DataFrame:
    """Features of all judged pairs, with the grade as it is. ``docs`` adds document columns.

    The pairs are stored, as they are used several times and each would read the lengths again; those of a lazy index
    come from its narrowed tables, so that the text is read once for both.
    """
    index = narrowed(index, analyze_topics(topics, analyzer, index.stemmed))
    pairs = materialize(judged_pairs(qrels, index, topics), "judged")
    if docs is not None:
        pairs = lookup_join(docs, pairs, "doc_id")
    out = extract_features(pairs, index, topics, names, analyzer)
    return out.select("qid", "doc_id", "grade", *column_names(_features(names)))


def extract_matching(
    qrels: DataFrame, index: TermIndex, topics: DataFrame, names: Sequence[str | Feature] = WEB_FEATURES, analyzer: Analyzer = tokens
) -> DataFrame:
    """Features of every document with every query it shares a term with; unjudged and negative grades become 0.

    Where the queries' terms can be sent to the tasks, pairs and sums come from the matches of each document in one go. Pairs
    that are judged more than once have several rows, which their sums are taken over; they go by the pairs, as all do otherwise.
    """
    from .rerank import with_grade

    query_tokens = analyze_topics(topics, analyzer, index.stemmed)
    index, found = narrowed(index, query_tokens), _features(names)
    aggregates, paired, weights = _parts(found, query_tokens, index)
    shown = ["qid", "doc_id", "grade", *column_names(found)]
    pairs = matching_pairs(index, topics, analyzer)
    if any(f.level == "sdm" for f in found) or not fits(query_tokens) or (paired and not fits(weights)):
        return extract_features(with_grade(pairs, qrels), index, topics, found, analyzer, most=True).select(*shown)
    met = matched_pairs(index, query_tokens, topics.count(), aggregates, weights, paired)
    judged = qrels.where("qid IS NOT NULL AND doc_id IS NOT NULL").groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    often = materialize(judged.where("n > 1").select("qid", "doc_id"), "often")
    again = None if often.isEmpty() else often
    if again is not None:
        met = lookup_join(met, again, ["qid", "doc_id"], "left_anti")
        pairs = lookup_join(pairs, again, ["qid", "doc_id"], "left_semi")
    out = _finished(with_grade(met, qrels), ["qid", "doc_id", "grade", "dl"], found, query_tokens, index, topics, weights, None).select(*shown)
    return out if again is None else out.unionByName(extract_features(with_grade(pairs, qrels), index, topics, found, analyzer).select(*shown))


def extract_run(
    run: DataFrame, qrels: DataFrame, index: TermIndex, topics: DataFrame, names: Sequence[str | Feature] = WEB_FEATURES,
    with_score: bool = False, docs: DataFrame | None = None, analyzer: Analyzer = tokens,
) -> DataFrame:
    """Features of a ranked list; ``with_score`` puts the retrieval score first.

    The run is stored first: the pairs are used several times, and it would be ranked anew for each.
    """
    from .rerank import with_grade

    run = materialize(run.select("qid", "doc_id", "score"), "run")
    pairs = with_grade(run.select("qid", "doc_id", "score"), qrels)
    if docs is not None:
        pairs = lookup_join(docs, pairs, "doc_id")
    out = extract_features(pairs, index, topics, names, analyzer)
    first = ["score"] if with_score else []
    return out.select("qid", "doc_id", "grade", *first, *column_names(_features(names)))
