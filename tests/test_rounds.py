"""Chains by lifted links, trees as expressions, and running aggregates in folded parts."""

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor

from quillrank import versions as vs
from quillrank.functions import text as tx
from quillrank.operators import joins as jn
from quillrank.operators import rerank as rr
from quillrank.streaming import counters as ct


def chains(spark, links, starts):
    frame = spark.createDataFrame(links, "id bigint, in_reply_to_status_id bigint")
    found = jn.reply_chain(frame, spark.createDataFrame([(s,) for s in starts], "id bigint")).collect()
    assert len(found) == len({(r.start_id, r.id) for r in found})
    return {(r.start_id, r.id): r.steps for r in found}


def walked(links, starts):
    up, out = dict(links), {}
    for start in starts:
        at, steps = start, 0
        while at in up and (start, at) not in out:
            out[start, at] = steps
            at, steps = up[at], steps + 1
    return out


def test_a_long_chain_takes_few_tables(spark, monkeypatch):
    written = []
    monkeypatch.setattr(jn, "materialize", lambda df, label, f=jn.materialize: written.append(label) or f(df, label))
    links = [(i, i - 1 if i else None) for i in range(5_000)]
    assert chains(spark, links, [4_999, 17]) == walked(links, [4_999, 17])
    assert len(written) < 20


@pytest.mark.parametrize("everything_fits", [True, False])
def test_chains_with_cycles_unknown_parents_and_no_starts(spark, monkeypatch, everything_fits):
    if not everything_fits:
        monkeypatch.setattr(jn, "fits", lambda df: False)
    links = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 99), (6, None), (7, 6), (8, 8), (9, 7), (10, 9), (11, 9)]
    starts = [1, 4, 5, 6, 8, 10, 11, 11, 77]
    assert chains(spark, links, starts) == walked(links, starts)
    assert chains(spark, links, []) == {}


def test_trees_are_the_model_they_come_from(spark):
    pick = random.Random(2)
    rows = [("q", i, pick.random() * 5, float(pick.randrange(9)), pick.random()) for i in range(200)]
    frame = spark.createDataFrame([r + (r[2] * 2 - r[3] * r[4],) for r in rows], "qid string, doc_id bigint, a double, b double, c double, grade double")
    names = ["a", "b", "c"]
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(frame)
    model = GBTRegressor(featuresCol="features", labelCol="grade", maxIter=4, maxDepth=4, seed=7).fit(assembled)
    trees = rr.trees_of(model, names)
    want = {r.doc_id: round(r.prediction, 6) for r in model.transform(assembled).collect()}
    scored = rr.score_features(frame, rr.tree_model(trees))
    assert {r.doc_id: r.score for r in scored.collect()} == pytest.approx(want, abs=1e-6)
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.s for r in frame.selectExpr("doc_id", f"round({rr.trees_sql(trees).replace(chr(34), '`').replace('::DOUBLE', 'D')}, 6) AS s").collect()} == pytest.approx(want, abs=1e-6)
    best = rr.rerank_by_model(frame, rr.tree_model(trees), 7).collect()
    assert sorted((r.rank, r.doc_id) for r in best) == [(k + 1, d) for k, (_, d) in enumerate(sorted(((s, d) for d, s in {r.doc_id: r.score for r in scored.collect()}.items()), reverse=True)[:7])]


def test_batches_leave_few_folders_and_one_version_to_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ct, "MOST_PARTS", 4)
    path, wrote, seen = str(tmp_path / "frequency"), [], {}

    class Writer:
        """Takes the place of a stream: hands batches to the function that it is given."""

        def __getattr__(self, name):
            return lambda *args, **more: wrote.append(args[0]) or self if name == "foreachBatch" else self

    monkeypatch.setattr(ct, "user_post_frequency", lambda *args: type("Stream", (), {"writeStream": Writer()})())
    ct.stream_user_frequency(None, path, "", "x", "x", 0.0, 0.0)
    for batch in range(14):
        rows = {f"u{batch % 5}": batch, f"w{batch}": 1}
        seen |= rows
        frame = spark.createDataFrame(list(rows.items()), "user_id string, n_posts bigint")
        reader, before = (ct.user_frequency(spark, path), dict(seen, **{})) if batch else (None, None)
        wrote[0](frame, batch)
        wrote[0](frame.limit(0), batch)  # a repeated batch changes nothing
        if batch:
            assert reader.count() == len({k for k in before} - {f"w{batch}"} - ({f"u{batch % 5}"} if batch < 5 else set()))
        assert len(vs.children(spark, f"{path}/rows")) <= 2 * 4 + 1
    assert {r.user_id: r.n_posts for r in ct.user_frequency(spark, path).collect()} == seen


def test_all_published_references(spark):
    cases = {f"&{name}": char for name, char in tx.named_characters().items()}
    frame = spark.createDataFrame([(f"x{k}y",) for k in cases], "html string")
    found = {r.html[1:-1]: r.text[1:-1] for r in frame.select("html", tx.html_to_text("html").alias("text")).collect()}
    blank = lambda c: " ".join(c.split()) or " "
    assert len(cases) > 2_000 and [k for k, c in cases.items() if found[k] != c and found[k] != blank(c)] == []
