"""Features of small random collections against the formulas, written out in plain Python."""

import itertools
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillrank.operators import features as ft
from quillrank.operators import ranking as rk
from quillrank.operators.postings import build_index, build_postings, coll_stats, doc_lengths, read_index, write_index

WORDS = "amber birch copper delta ember fern garnet hazel iris jade".split()


def collection(seed):
    """Documents (one of them empty) and queries with repeats and unknown words."""
    pick = random.Random(seed)
    docs = [[pick.choice(WORDS[: 4 + seed]) for _ in range(pick.randrange(3, 24))] for _ in range(6)] + [[]]
    queries = [[pick.choice(WORDS) for _ in range(n)] for n in (1, 2, 3, 5)] + [["amber", "birch", "amber", "copper", "unknown"]]
    return docs, queries


def expected(docs, query, doc, k1=1.2, b=0.75):
    """All features of one pair by their definitions."""
    n, size = len(docs), [len(d) for d in docs]
    df = Counter(t for d in docs for t in set(d))
    ctf = Counter(t for d in docs for t in d)
    total, mean = sum(size), sum(size) / n
    text, tf, qtf = docs[doc], Counter(docs[doc]), Counter(query)
    met = [t for t in qtf if tf[t]]
    length, dl = len(query), len(text)

    def idf(t):
        return math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))

    def pmi(x, y):
        both = sum(x in d and y in d for d in docs)
        return math.log(both / (df[x] * df[y])) if both else 0.0

    known = [t for t in qtf if ctf[t]]
    pairs = list(itertools.combinations(sorted(qtf), 2))
    out = {
        "QueryLength": length, "UniqueQueryTerms": len(qtf), "MatchingTermCount": len(met), "DocSize": dl,
        "AvgIDF": sum(q * idf(t) for t, q in qtf.items()) / length,
        "AvgSCQ": sum(qtf[t] * (1 + math.log(ctf[t] * idf(t))) for t in known) / length,
        "SimplifiedClarityScore": sum(qtf[t] / length * math.log(qtf[t] / length / (ctf[t] / total)) for t in known),
        "PMIFeature": sum(pmi(x, y) for x, y in pairs) / len(pairs) if pairs else 0.0,
        "AvgICTF": sum(math.log(dl / tf[t]) for t in met) / length,
        "TFIDF": sum(qtf[t] * math.sqrt(tf[t]) * (1 + math.log(n / (df[t] + 1))) ** 2 for t in met) * len(met) / length,
        "BM25Feature": sum(idf(t) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * dl / mean)) for t in met),
    }
    for name in ("SumMatchingTf", "SumTermFrequency", "UnigramsFeatureExtractor"):
        out[name] = sum(tf[t] for t in met)
    neighbours = set(zip(query, query[1:]))
    ahead = {(x, y) for i, x in enumerate(query) for y in query[i + 1 :]}
    last = {x: i for i, x in enumerate(query[:-1])}
    kept = {(x, y) for x, i in last.items() for y in query[i + 1 :]}
    for gap in (1, 2, 6, 8, 10):
        near = [(text[i], text[j]) for i in range(dl) for j in range(i + 1, min(dl, i + gap + 1))]
        out[f"OrderedSequentialPairs{gap}"] = sum(p in neighbours for p in near)
        out[f"UnorderedSequentialPairs{gap}"] = sum((p in neighbours) + (p[::-1] in neighbours) for p in near)
        out[f"OrderedAllPairs{gap}"] = sum(p in kept for p in near)
        out[f"UnorderedQueryTokenPairs{gap}"] = sum((p in ahead) + (p[::-1] in ahead) for p in near)
    return out


def extract(spark, names, docs, queries, index=None):
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id BIGINT, text STRING")
    topics = spark.createDataFrame([(str(i), " ".join(q)) for i, q in enumerate(queries)], "qid STRING, query STRING")
    pairs = spark.createDataFrame([(str(q), d) for q in range(len(queries)) for d in range(len(docs))], "qid STRING, doc_id BIGINT")
    features = [ft.feature(n) if isinstance(n, str) else n for n in names]
    rows = ft.extract_features(pairs, index or build_index(frame), topics, features).collect()
    return {(int(r.qid), r.doc_id): [r[c] for c in ft.column_names(features)] for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_default_features_equal_their_formulas(spark, seed):
    docs, queries = collection(seed)
    found = extract(spark, ft.WEB_FEATURES, docs, queries)
    assert len(found) == len(docs) * len(queries)
    for (q, d), values in found.items():
        want = expected(docs, queries[q], d)
        assert values == pytest.approx([want[n] for n in ft.WEB_FEATURES], abs=1e-9), (q, d)


def test_pair_features_of_all_kinds(spark):
    names = [f"{kind}{gap}" for kind in ft.PAIR_KINDS for gap in (1, 2, 6)]
    docs, queries = collection(1)
    for (q, d), values in extract(spark, names, docs, queries).items():
        want = expected(docs, queries[q], d)
        assert values == [want[n] for n in names], (q, d)


def test_default_pairs_are_linear_in_the_query(spark):
    tokens = spark.createDataFrame([("1", i, f"t{i}") for i in range(300)], "qid STRING, pos INT, term STRING")
    assert ft.query_pairs(tokens, adjacent=True).count() == 2 * 299


def test_stored_index_gives_the_same_features_from_its_buckets(spark, tmp_path):
    docs, queries = collection(2)
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id BIGINT, text STRING")
    write_index(frame, str(tmp_path / "index"))
    index = read_index(spark, str(tmp_path / "index"))
    for (q, d), values in extract(spark, ft.WEB_FEATURES, docs, queries, index).items():
        assert values == pytest.approx([expected(docs, queries[q], d)[n] for n in ft.WEB_FEATURES], abs=1e-9)
    tokens = rk.analyze_topics(spark.createDataFrame([("0", "amber birch")], "qid STRING, query STRING"))
    pairs = spark.createDataFrame([("0", 1)], "qid STRING, doc_id BIGINT")
    plan = ft.pair_matches(pairs, tokens, index)._jdf.queryExecution().executedPlan().toString()
    assert "term_bucket" in plan.split("PartitionFilters:", 1)[1].split("]", 1)[0] and "dynamicpruning" in plan


def test_stemmed_queries_and_documents_meet(spark, tmp_path):
    frame = spark.createDataFrame([(0, "walking dogs barked"), (1, "a dog walks"), (2, "cats")], "doc_id BIGINT, text STRING")
    write_index(frame, str(tmp_path / "stems"), stem=True)
    for index in (build_index(frame, stem=True), read_index(spark, str(tmp_path / "stems"))):
        for query, want in (("dog", [0, 1]), ("dogs", [0, 1]), ("walked barking", [0, 1]), ("cat", [2])):
            topics = spark.createDataFrame([("1", query)], "qid STRING, query STRING")
            assert sorted(r.doc_id for r in rk.bm25(index, topics).collect()) == want
    topics = spark.createDataFrame([("1", "walks dogs")], "qid STRING, query STRING")
    pairs = spark.createDataFrame([("1", 0)], "qid STRING, doc_id BIGINT")
    assert ft.extract_features(pairs, build_index(frame, stem=True), topics, ["OrderedSequentialPairs1"]).first()["OrderedSequentialPairs1"] == 1


def test_feature_set_from_json(spark):
    text = (
        '{extractors: [ {name: "DocSize"}, {name: "QueryLength"}, {name: "OrderedSequentialPairs", params:{gapSize: 2}},'
        ' {name: "UnorderedSequentialPairs", params:{gapSize : 2}}, {name: Unheard}, {name: BM25Feature, params: {k1:0.9, b:0.4}} ]}'
    )
    docs, queries = collection(1)
    for (q, d), values in extract(spark, ft.load_feature_set(text), docs, queries).items():
        want = expected(docs, queries[q], d, 0.9, 0.4)
        assert values == pytest.approx([want[n] for n in ("DocSize", "QueryLength", "OrderedSequentialPairs2", "UnorderedSequentialPairs2", "BM25Feature")], abs=1e-9)
    assert ft.load_feature_set("{extractors: []}") == []


def test_repeated_features_keep_order_and_get_numbers(spark):
    features = ft.load_feature_set("{extractors: [ {name:QueryLength}, {name: MatchingTermCount}, {name : QueryLength} ]}")
    assert ft.column_names(features) == ["QueryLength", "MatchingTermCount", "QueryLength_2"]
    assert extract(spark, features, [["fern", "jade"]], [["fern", "iris"]]) == {(0, 0): [2, 1, 2]}


def test_registered_feature(spark):
    ft.register_feature("HalfLength", lambda params: ft.Feature("HalfLength", "row", lambda index: F.col("dl") / 2))
    assert extract(spark, ["HalfLength"], [["fern"] * 3], [["fern"]]) == {(0, 0): [1.5]}
    with pytest.raises(ValueError):
        extract(spark, ["Nothing"], [["fern"]], [["fern"]])


def test_default_sets_are_complete():
    assert len(ft.WEB_FEATURES) == 20 and len(ft.STATUS_FEATURES) == 25
    assert all(ft.feature(n) for n in ft.STATUS_FEATURES)


def test_merged_partners_of_a_repeated_token(spark):
    tokens = spark.createDataFrame([("1", i, t) for i, t in enumerate("a b a c".split())], "qid STRING, pos INT, term STRING")
    last = {(r.t1, r.t2) for r in ft.query_pairs(tokens).where("ordered_all > 0").collect()}
    merged = {(r.t1, r.t2) for r in ft.query_pairs(tokens, merge_repeats=True).where("ordered_all > 0").collect()}
    assert last == {("a", "c"), ("b", "a"), ("b", "c")}
    assert merged == last | {("a", "b"), ("a", "a")}


def test_sdm_by_hand(spark):
    got = extract(spark, ["SDM"], [["fern", "jade", "iris", "jade"]], [["fern", "jade"]])[0, 0]
    size = math.log(5)
    terms = math.log(2) + math.log(3) - 2 * size
    ordered = math.log(2) - size
    window = math.log(1 + 2) - size  # (fern, jade) at distances 1 and 3
    assert got[0] == pytest.approx(0.5 * terms + 0.2 * ordered + 0.3 * window, abs=1e-9)


def test_collection_without_tokens(spark):
    docs = spark.createDataFrame([(1, "..."), (2, "")], "doc_id BIGINT, text STRING")
    assert build_postings(docs).count() == 0
    assert coll_stats(doc_lengths(build_postings(docs))).first().avgdl == 1.0
    stats = build_index(docs).stats.first()
    assert (stats.n_docs, stats.sum_dl, stats.avgdl) == (2, 0, 1.0)


def test_matching_pairs_are_summed_up_by_document(spark, monkeypatch):
    """Repeated and missing ids of documents, and pairs that are judged twice, against the way by pairs."""
    pick = random.Random(7)
    rows = [(i % 9 if i % 8 else None, " ".join(pick.choice(WORDS) for _ in range(pick.randrange(25)))) for i in range(14)]
    queries = [[pick.choice(WORDS) for _ in range(n)] for n in (1, 2, 3, 6)]
    topics = spark.createDataFrame([(str(i), " ".join(q)) for i, q in enumerate(queries)] + [(None, "amber birch"), ("9", "unknown")], "qid STRING, query STRING")
    qrels = spark.createDataFrame([("1", 1, 2), ("2", 3, 1), ("2", 3, 0), ("3", 5, -1), (None, 1, 1), ("3", None, 1)], "qid STRING, doc_id BIGINT, grade INT")
    names = [*(n for n in ft.WEB_FEATURES if n != "PMIFeature"), "OrderedAllPairs3", "UnorderedQueryTokenPairs10"]

    def shown():
        index = build_index(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").coalesce(1))
        found = ft.extract_matching(qrels, index, topics, names)
        return found, sorted((tuple(r) for r in found.select("qid", "doc_id", "grade", "DocSize", *(F.round(n, 9) for n in names)).collect()), key=str)

    frame, by_document = shown()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan.replace("\n", "")
    monkeypatch.setattr(ft, "matched_pairs", None)
    monkeypatch.setattr(ft, "fits", lambda df, max_rows=0: False)
    assert by_document == shown()[1]
    assert len([r for r in by_document if r[:2] == ("2", 3)]) == 2 and any(r[1] is None for r in by_document)


def test_close_pairs_of_a_document_for_all_queries(spark):
    weights = ft.PairWeights.of(ft.query_pairs(spark.createDataFrame(
        [(q, i, t) for q, text in (("q", "a b c"), ("r", "b a"), ("s", "c")) for i, t in enumerate(text.split())], "qid STRING, pos INT, term STRING")).toArrow())
    places = [[("a", [0, 4]), ("b", [1, 9]), ("z", [2])], [("c", [3])], [("a", [0, 1]), ("b", [1, 2])]]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": [5, 6, 7],
        "places": pa.array([[{"term": t, "positions": p} for t, p in d] for d in places], pa.list_(pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32()))])))})
    found = ft.document_pairs(batch, weights, [("o", "ordered_next", 3), ("u", "unordered_next", 5)], 5).to_pylist()
    # Of document 7, whose positions repeat, a query sees its own tokens a0 a1 b1 b2.
    assert {(r["qid"], r["doc_id"], r["o"], r["u"]) for r in found} == {("q", 5, 1, 3), ("r", 5, 1, 3), ("q", 7, 4, 4), ("r", 7, 0, 4)}
