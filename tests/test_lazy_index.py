"""A lazy index forms its postings once for a job, and only those of the query terms."""

import pyarrow as pa

from quillrank.operators import postings as po
from quillrank.operators import ranking as rk

DOCS = [(1, "b a b"), (2, "c c"), (2, "c c"), (3, ""), (None, "a"), (4, None)]


def test_a_ranking_does_not_form_postings_again(spark):
    index = po.build_index(spark.createDataFrame(DOCS, "doc_id long, text string"))
    topics = spark.createDataFrame([("q", "a c z")], "qid string, query string")
    run = rk.bm25(index, topics)
    assert "regexp_extract_all(lower(text" not in run._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id for r in run.collect()} == {1, 2, None}


def test_narrowed_counts_what_the_whole_index_has(spark):
    index = po.build_index(spark.createDataFrame(DOCS, "doc_id long, text string"))
    terms = spark.createDataFrame([("a",), ("c",), ("z",)], "term string")
    less = po.narrowed(index, terms)
    assert less.stats.first() == index.stats.first()
    assert sorted(map(tuple, less.lengths.collect()), key=str) == sorted(map(tuple, index.lengths.collect()), key=str)
    assert sorted(map(tuple, less.terms.collect())) == [("a", 2, 2), ("c", 2, 4)]
    whole = index.postings.where("term IN ('a', 'c')")
    assert sorted(map(tuple, less.postings.select(whole.columns).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_postings_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"doc_id": [7, 8, None], "tokens": pa.array([["b", "a", "b"], [], ["a"]], pa.list_(pa.string()))})
    found = po.posting_batch(batch, True).to_pylist()
    assert {(r["doc_id"], r["term"], r["tf"], tuple(r["positions"] or ()), r["dl"], r["head"]) for r in found} == {
        (7, "b", 2, (0, 2), 3, True), (7, "a", 1, (1,), 3, False), (None, "a", 1, (0,), 1, True), (8, None, None, (), 0, True)}
