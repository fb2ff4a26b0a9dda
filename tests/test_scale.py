"""Plans and the join paths that only large inputs take."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quillrank import sizing
from quillrank.operators import features as ft
from quillrank.operators import geo
from quillrank.operators import joins as jn
from quillrank.operators import postings as po
from quillrank.operators import ranking as rk
from quillrank.operators import rerank as rr
from quillrank.plans import fixtures as fx
from quillrank.session import materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def nothing_fits(monkeypatch):
    """Every size check fails, so every join takes its shuffle path with split hot keys."""
    refuse = lambda df, max_rows=0: False
    for module in (sizing, rk, ft, jn):
        monkeypatch.setattr(module, "fits", refuse)
    monkeypatch.setattr(sizing, "HOT_SHARE", 0.02)


def test_build_has_no_shuffle(spark, sf_dir):
    docs = fx.corpus(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism * 3).cache()
    docs.count()
    postings = po.build_postings(docs)
    shown = plan(postings).split("InMemoryTableScan")[0]
    assert "Exchange" not in shown and "Aggregate" not in shown


def test_postings_are_not_shuffled_for_ranking(spark, sf_dir):
    run = rk.bm25(fx.index(spark, sf_dir), fx.topics(spark, sf_dir))
    shown = plan(run)
    assert "WindowGroupLimit" in shown and "SortMergeJoin" not in shown and "CartesianProduct" not in shown


def test_stored_index_reads_only_the_buckets_of_the_query(spark, sf_dir, tmp_path):
    po.write_index(fx.corpus(spark, sf_dir), str(tmp_path / "ix"), buckets=16)
    index = po.read_index(spark, str(tmp_path / "ix"))
    run = rk.search(index, "the of", 5)
    assert "dynamicpruning" in plan(run)
    lazy = rk.search(fx.index(spark, sf_dir), "the of", 5)
    assert rows(run) == rows(lazy)
    assert "positions" not in plan(run).split("ReadSchema")[1]


def test_filters_reach_the_scan(spark, sf_dir):
    statuses = fx.statuses(spark, sf_dir)
    shown = plan(statuses.select("id", "lang").where("id <= 50"))
    assert "LessThanOrEqual(doc_id,50)" in shown and "text" not in shown.split("ReadSchema")[1].split("\n")[0]


def test_ranking_without_broadcast(spark, sf_dir, nothing_fits, monkeypatch):
    index, topics = fx.index(spark, sf_dir), fx.topics(spark, sf_dir)
    split = rows(rk.bm25(index, topics))
    monkeypatch.undo()
    assert split == rows(rk.bm25(index, topics)) and split


def test_features_without_broadcast(spark, sf_dir, monkeypatch):
    index, topics, qrels = fx.index(spark, sf_dir, True), fx.topics(spark, sf_dir), fx.qrels(spark, sf_dir)
    names = ["BM25Feature", "AvgIDF", "UnorderedSequentialPairs6"]

    def shown():
        found = ft.extract_judged(qrels, index, topics, names)
        return rows(found.select("qid", "doc_id", "grade", *(F.round(n, 6) for n in names)))

    usual = shown()
    for module in (sizing, rk, ft, jn):
        monkeypatch.setattr(module, "fits", lambda df, max_rows=0: False)
    assert shown() == usual


def test_geo_without_broadcast(spark, sf_dir, monkeypatch):
    statuses, cities = fx.statuses(spark, sf_dir).cache(), fx.cities(spark, sf_dir)
    usual = rows(geo.assign_city(statuses, cities).select("id", "city_no"))
    roots = rows(jn.reply_roots(fx.replies(spark, sf_dir)))
    chain = rows(jn.reply_chain(fx.replies(spark, sf_dir), fx.replies(spark, sf_dir).select("id")))
    for module in (sizing, jn):
        monkeypatch.setattr(module, "fits", lambda df, max_rows=0: False)
    assert rows(geo.assign_city(statuses, cities).select("id", "city_no")) == usual
    assert rows(jn.reply_roots(fx.replies(spark, sf_dir))) == roots
    assert rows(jn.reply_chain(fx.replies(spark, sf_dir), fx.replies(spark, sf_dir).select("id"))) == chain


def test_hot_and_missing_keys_are_split(spark):
    big = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 1000, 7).when(F.col("id") < 2000, F.lit(None)).otherwise(F.col("id")).alias("k"))
    other = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = rows(sizing.split_hot_join(big, other, ["k"], how, "id").select("id"))
        assert got == rows(big.join(other, "k", how).select("id"))
    joined = sizing.split_hot_join(big, other, ["k"], "left", "id")
    assert joined.where("k = 7").select("v").distinct().collect()[0].v == 14


def test_fits_stops_at_the_bound(spark):
    assert sizing.fits(spark.range(10), 10)
    assert not sizing.fits(spark.range(11), 10)


def test_numbering_is_dense_over_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    assert rows(po.numbered(df, "k")) == [(i, i) for i in range(1000)]


def test_city_grid_against_brute_force(spark):
    points = spark.range(4000).select(
        "id", (F.rand(3) * 0.6 - 0.3).alias("longitude"), (F.rand(4) * 0.6 - 0.3).alias("latitude"),
        F.when(F.col("id") % 9 == 0, "Two").when(F.col("id") % 10 == 0, "Zwei").alias("place"),
    ).cache()
    edge = spark.createDataFrame([(5000, 0.15, 0.05, None), (5001, -0.05, -0.05, None), (5002, None, 0.0, "Two")], "id BIGINT, longitude DOUBLE, latitude DOUBLE, place STRING")
    points = points.union(edge)
    cities = spark.createDataFrame(
        [(0, "One", [], 0.1, 0.1), (1, "Two", ["Zwei"], -0.1, -0.1), (2, "Three", [], 0.12, 0.08)],
        "city_no INT, name STRING, aliases ARRAY<STRING>, lon DOUBLE, lat DOUBLE",
    )
    got = rows(geo.assign_city(points, cities).select("id", "city_no"))
    want, centres = [], cities.collect()
    for p in points.collect():
        for c in centres:
            boxed = p.longitude is not None and c.lon - 0.05 <= p.longitude <= c.lon + 0.05 and c.lat - 0.05 <= p.latitude <= c.lat + 0.05
            if boxed or p.place in [c.name, *c.aliases]:
                want.append((p.id, c.city_no))
    assert got == sorted(want) and len(got) > 500


def test_tie_islands_by_hand(spark):
    scores = [("1", 5, 2.0), ("1", 4, 1.9995), ("1", 9, 1.9995), ("1", 3, 1.0), ("1", 3, 1.0), ("1", 2, 0.9995), ("2", 1, 0.0005)]
    run = spark.createDataFrame([(*s, None) for s in scores], "qid STRING, doc_id BIGINT, score DOUBLE, retweeted_status_id BIGINT")
    got = {(r.qid, r.doc_id): (round(r.score, 7), r["rank"]) for r in rr.tiebreak_recent(run).collect()}
    assert got == {
        ("1", 5): (2.0, 1), ("1", 9): (1.999499, 2), ("1", 4): (1.999498, 3), ("1", 3): (1.0, 4), ("1", 2): (0.999499, 5),
        ("2", 1): (0.000499, 1),
    }


def test_reply_cycle_has_no_root(spark):
    rows_in = [(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5)]
    df = spark.createDataFrame(rows_in, "id BIGINT, in_reply_to_status_id BIGINT")
    got = {r.id: (r.root_id, r.depth) for r in jn.reply_roots(df).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0), 5: (None, None), 6: (None, None)}


def test_reply_chain_ends_in_a_cycle(spark):
    """0 <- 1 <- 2 is a chain; 5 -> 6 -> 7 -> 5 is a cycle that 9 leads to."""
    df = spark.createDataFrame([(0, None), (1, 0), (2, 1), (5, 6), (6, 7), (7, 5), (9, 5)], "id BIGINT, in_reply_to_status_id BIGINT")
    got = {}
    for r in jn.reply_chain(df, df.select("id")).collect():
        got.setdefault(r.start_id, {})[r.id] = r.steps
    assert got[2] == {2: 0, 1: 1, 0: 2} and got[5] == {5: 0, 6: 1, 7: 2} and got[9] == {9: 0, 5: 1, 6: 2, 7: 3}


def test_ranks_beyond_the_group_limit(spark):
    scored = spark.range(5_000).selectExpr("'q' AS qid", "id AS doc_id", "CAST(id % 977 AS DOUBLE) AS score")
    whole = scored.orderBy("score", ascending=False).count()
    got = [(r.doc_id, r.rank) for r in rk.top_k(scored, 2_000).orderBy("rank").collect()]
    want = sorted(range(whole), key=lambda i: (-(i % 977), i))[:2_000]
    assert got == [(d, n) for n, d in enumerate(want, 1)]


def test_timeline_pieces_do_not_depend_on_other_users(spark):
    rows_in = [("a", i, f"a{i}") for i in range(3)] + [("b", i, f"b{i}") for i in range(2)]
    df = spark.createDataFrame(rows_in, "user_id string, id long, text string")
    pieces = {(r.user_id, r.piece): r.text for r in geo.user_timelines(df, 2).collect()}
    assert pieces == {("a", 0): "a0 a1", ("a", 1): "a2", ("b", 0): "b0 b1"}
    assert geo.user_timelines(df).count() == 2


def test_repeated_append_changes_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"fern jade t{i}") for i in range(20)], "doc_id long, text string")
    path = str(tmp_path / "index")
    po.write_index(docs.where("doc_id < 15"), path)
    for _ in range(2):
        po.write_index(docs, path, mode="append")
        index = po.read_index(spark, path)
        stats = index.stats.first()
        assert (stats.n_docs, stats.sum_dl, index.lengths.count()) == (20, 60, 20)
        assert index.terms.where("term = 'fern'").first().df == 20


def test_close_positions_are_counted_without_rows(spark, monkeypatch):
    schema = "qid string, doc_id bigint, term string, positions array<int>"
    data = [("q", 1, "a", [0, 3, 9]), ("q", 1, "b", [1, 20]), ("q", 1, "ü", [2]), ("r", 1, "a", [0, 3, 9]), ("r", 2, "b", [5, 5]), ("r", 2, "b", [5]), ("r", 2, "a", [4]), ("s", 2, "a", [4])]
    matches = spark.createDataFrame(data, schema)
    tokens = spark.createDataFrame([("q", i, t) for i, t in enumerate("abüab")] + [("r", 0, "b"), ("r", 1, "a"), ("r", 2, "b")], "qid string, pos int, term string")
    weights, kinds = ft.query_pairs(tokens), [ft.feature(f"{name}{gap}") for name in ft.PAIR_KINDS for gap in (1, 3, 10)]
    counted = ft.count_pairs(matches, weights, kinds)
    assert "Generate" not in plan(counted).split("MapInArrow")[1]
    monkeypatch.setattr(ft, "fits", lambda df, max_rows=0: False)
    some = F.greatest(*(f.name for f in kinds)) > 0
    usual = rows(ft.count_pairs(matches, weights, kinds).where(some))
    assert rows(counted.where(some)) == usual and len(usual) == 2
    assert counted.count() == 4


def test_background_meets_in_blocks(spark, monkeypatch):
    hits = spark.createDataFrame([(i if i % 9 else None, f"u{i % 3}" if i % 7 else None) for i in range(90)] + [(1, "u1")] * 20, "id bigint, user_id string")
    terms = spark.createDataFrame([(f"u{u}", f"t{t}", t + u) for u in range(4) for t in range(30)] + [(None, "t", 1)], "user_id string, term string, tf bigint")
    monkeypatch.setattr(jn, "HIT_BLOCK", 4)
    monkeypatch.setattr(jn, "TERM_BLOCK", 7)
    found = jn.background_terms(hits, terms)
    assert "Generate inline(ids" in plan(found) and "Generate inline(terms" in plan(found)
    assert found.rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, terms.join(hits, "user_id").select("id", "term", "tf").collect()), key=key)
    none = jn.background_terms(hits.where("false"), terms)
    assert none.count() == 0 and none.columns == ["id", "term", "tf"]


def test_timelines_meet_blocks_of_hits(spark, monkeypatch):
    hits = spark.createDataFrame([(i if i % 9 else None, f"u{i % 3}" if i % 7 else None, i % 2) for i in range(90)] + [(1, "u1", 0)] * 20, "id bigint, user_id string, odd int")
    pieces = spark.createDataFrame([(f"u{u}", p if p else None, 2, f"text {u} {p}" if p != 3 else None) for u in range(4) for p in range(12)] + [(None, 0, 1, "t")], "user_id string, piece bigint, n_texts bigint, text string")
    want = hits.join(pieces.withColumnRenamed("text", "timeline"), "user_id").select("user_id", "id", "odd", "piece", "timeline")
    key = lambda r: tuple((v is None, v) for v in r)
    want = sorted(map(tuple, want.collect()), key=key)
    whole = jn.with_timeline(hits, pieces)
    assert "Generate inline(_hits" in plan(whole) and whole.rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(jn, "HIT_BLOCK", 4)
    monkeypatch.setattr(jn, "PART_BLOCKS", 2)
    found = jn.with_timeline(hits, pieces)
    for df in (whole, found):
        assert df.columns == ["user_id", "id", "odd", "piece", "timeline"] and sorted(map(tuple, df.collect()), key=key) == want
    monkeypatch.setattr(jn, "fits", lambda df, max_rows=0: False)
    monkeypatch.setattr(sizing, "fits", lambda df, max_rows=0: False)
    assert sorted(map(tuple, jn.with_timeline(hits, pieces).collect()), key=key) == want
    assert jn.with_timeline(hits.where("false"), pieces).count() == 0


def test_features_of_judged_pairs_read_the_text_once(spark, sf_dir):
    found = ft.extract_judged(fx.qrels(spark, sf_dir), fx.index(spark, sf_dir), fx.topics(spark, sf_dir), ["BM25Feature", "DocSize"])
    assert "documents.parquet" not in plan(found) and found.count() > 0


def test_features_of_a_stored_index_sum_up_pairs_once(spark, sf_dir, monkeypatch):
    index, topics = fx.stored_index(spark, sf_dir, True), fx.topics(spark, sf_dir)
    counted, run = [], rk.bm25(index, topics, hits=20)
    for module in (sizing, ft, jn):
        monkeypatch.setattr(module, "fits", lambda df, *more, f=sizing.fits: counted.append(plan(df)) or f(df, *more))
    found = ft.extract_run(run, fx.qrels(spark, sf_dir), index, topics)
    assert counted and not [p for p in counted if "collect_list(struct(term" in p or "FlatMapGroups" in p]
    # Terms that the queries don't have are left out before they become rows.
    assert "inline(filter(terms" in plan(found)


def test_shuffle_files_go_as_a_table_is_written(spark, sf_dir, tmp_path):
    def files():
        tops = spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
        return {name for top in tops for _, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}

    before = files()
    stored = materialize(spark.range(1000).repartition(7, "id"))
    po.write_index(fx.corpus(spark, sf_dir), str(tmp_path / "index"), buckets=2)
    po.compact(spark, str(tmp_path / "index"), str(tmp_path / "compact"), 2)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert stored.count() == 1000
    names = ["doc_id", "term", "tf", "positions", "dl"]
    assert rows(po.read_index(spark, str(tmp_path / "compact")).postings.select(names)) == rows(po.read_index(spark, str(tmp_path / "index")).postings.select(names))
