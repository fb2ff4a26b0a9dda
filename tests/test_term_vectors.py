"""Vectors beyond the bound: those of frequent terms are broadcast, the others shuffled; no posting is lost."""

from pyspark.sql import functions as F

from quillrank.operators import joins as jn


def test_postings_of_frequent_terms_are_not_shuffled(spark):
    rows = [(i, f"t{i % k}", 1) for i in range(60) for k in (1, 2, 30)] + [(None, "t0", 2), (5, None, 1), (6, "none", 1)]
    postings = spark.createDataFrame(rows, "doc_id long, term string, tf int")
    vectors = spark.createDataFrame([(f"t{i}", [float(i), 1.0]) for i in range(30)], "term string, embedding array<float>")
    found = jn.term_vectors(postings, vectors, max_rows=2)
    want = postings.join(vectors, "term")
    shown = [F.col("doc_id"), F.col("term"), F.col("tf"), F.col("embedding")]
    key = lambda df: sorted(map(str, df.select(*shown).collect()))
    assert key(found) == key(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "BroadcastHashJoin [term" in plan
