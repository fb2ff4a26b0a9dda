"""Substring, exact and near-duplicate operators against brute force, on awkward rows and whole tables."""

import collections
import hashlib
import itertools
import random

import duckdb
import numpy as np
import pytest
from helpers import awkward, components, documents, multiset, near, prose, words
from pyspark.sql import functions as F

from quillrank.llm import components as cc
from quillrank.llm import hyperminhash as hm
from quillrank.llm.ego_join import embedding_duplicates
from quillrank.llm.exact_dedup import drop_exact_copies, exact_dedup
from quillrank.llm.queries import QUERIES, SQL
from quillrank.llm.substring_dedup import COVER, PERIOD, substring_dedup


def removed(rows, window=35):
    """Brute force: ``(id, n_words, n_removed, kept)`` of all rows."""
    starts = collections.Counter()
    cut = [(i, words(t)) for i, t in rows]
    for _, w in cut:
        starts.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = collections.Counter()
    for i, w in cut:
        gone = set()
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out[i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    return out


def test_cover_meets_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_substring_dedup_awkward(spark):
    rows = awkward() + [(20, "x " * 200), (21, prose(5, 34)), (22, prose(5, 34) + " y"), (23, "q " + prose(6, 35)), (24, prose(6, 35) + " z"), (25, prose(7, 200)), (26, "a b " + prose(7, 120))]
    assert multiset(substring_dedup(documents(spark, rows)), "doc_id", "n_words", "n_removed", "kept") == removed([r[:2] for r in rows])
    assert substring_dedup(documents(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_aligned_anywhere(spark, seed):
    pick = random.Random(seed)
    shared = prose(100 + seed, 90)
    rows = [(i, " ".join([prose(1000 * seed + i, pick.randrange(30)), *shared.split()[pick.randrange(30) : 40 + pick.randrange(50)], prose(i, pick.randrange(40))])) for i in range(12)]
    assert multiset(substring_dedup(documents(spark, rows, False)), "doc_id", "n_words", "n_removed", "kept") == removed(rows)


def test_op1_on_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = collections.Counter({(i, n, k, hashlib.sha256(t.encode()).hexdigest()): c for (i, n, k, t), c in removed(rows).items()})
    assert multiset(QUERIES["op1_substring_dedup"](spark, sf_dir), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_exact_dedup_awkward(spark):
    rows = awkward()
    found = exact_dedup(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    groups = collections.defaultdict(list)
    for i, t in (r[:2] for r in rows):
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    for digest, ids in groups.items():
        own = [r for r in found if r.text_sha256 == digest]
        top = max((i for i in ids if i is not None), default=None)
        assert sorted(str(r.doc_id) for r in own) == sorted(map(str, ids))
        assert {(r.keep_id, r.group_size) for r in own} == {(top, len(ids))}
        assert [r.doc_id for r in own if r.kept] == [top]
    assert exact_dedup(documents(spark, [])).collect() == []


def test_drop_exact_copies_keeps_one_row_each(spark):
    docs = documents(spark, awkward())
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert multiset(left, F.coalesce("text", F.lit(""))) == collections.Counter({((t or ""),): 1 for _, t in (r[:2] for r in awkward())})
    assert {r._key for r in left.collect()} == {"x"}


def test_op9_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert multiset(QUERIES["op9_exact_dedup"](spark, sf_dir), *names) == collections.Counter(con.execute(f"SELECT {', '.join(names)} FROM ({SQL['op9_exact_dedup']})").fetchall())


def test_near_duplicates_awkward(spark):
    rows = [r for r in awkward() if r[0] is not None]
    base = prose(40, 200).split()
    for k in range(40):  # a chain of copies, each a little further away
        base[(5 * k) % 200] = f"c{k}"
        rows.append((100 + k, " ".join(base)))
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in hm.near_duplicates(documents(spark, rows)).collect()}
    want = near(dict((r[:2]) for r in rows).items())
    assert found == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert hm.near_duplicates(documents(spark, [])).collect() == []
    odd = hm.near_duplicates(documents(spark, [(None, prose(1, 50)), (5, prose(1, 50)), (None, None)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in odd) == [("5", "5", True), ("None", "None", True), ("None", "None", True)]


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hm, "BLOCK_DOCS", 4)
    pick = random.Random(3)
    base = prose(50, 150).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(pick.randrange(12)):
            w[pick.randrange(len(w))] = f"e{pick.random()}"
        rows.append((i, " ".join(w[: 150 - pick.randrange(30)])))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in hm.near_duplicates(documents(spark, rows)).collect()}
    assert found == near(rows)


def test_linked_neighbourhood_costs_no_pairs_of_blocks(spark, monkeypatch):
    """Tasks are narrow rows, a few for each member where all are linked with a leader, and more are made for the others."""
    monkeypatch.setattr(hm, "BLOCK_DOCS", 4)
    made, links = [], hm._links
    monkeypatch.setattr(hm, "_links", lambda rows: made.append((dict(rows.dtypes)["task"], rows.count())) or links(rows))
    base = prose(60, 200).split()
    rows = [(i, " ".join([*base[:100], f"e{i}", *base[101:]])) for i in range(80)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in hm.near_duplicates(documents(spark, rows)).collect()}
    assert found == near(rows)
    assert all(kind == "bigint" for kind, _ in made) and sum(n for _, n in made) <= 3 * len(rows)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    both, only = rng.integers(0, 2**64, 6000, np.uint64), rng.integers(0, 2**64, (2, 500), np.uint64)
    sets = [np.unique(np.concatenate([both, x])) for x in only]
    table = hm.registers(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
    guess, used = hm.estimate(table[:1], table[1:])
    assert used[0, 0] == hm.REGISTERS and abs(guess[0, 0] - 6000 / 7000) < 0.1


def test_op6_on_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op6_minhash_near_dedup"](spark, sf_dir).collect()}
    assert found == near(rows)


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (None, 3), (205, 200), (200, 207), (207, 205)]
    found = {r.id: r.component for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert found == components(set(itertools.chain(*real)), real)


def linked(rows, threshold=0.93):
    """Brute force over ``(vec_id, embedding, label)`` with unique ids."""
    ok = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            ok[i] = (label, x / np.linalg.norm(x))
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= threshold]
    least = components([r[0] for r in rows], links)
    return {i: (sum(i in p for p in links), least[i]) for i, _, _ in rows}


def test_embeddings_awkward(spark, monkeypatch):
    rng = np.random.default_rng(2)
    near_ = rng.normal(size=8)
    rows = [(1, None, 0), (2, [], 0), (3, [0.0] * 8, 0), (4, [None] + [1.0] * 7, 0), (5, [float("nan")] + [1.0] * 7, 0), (6, [float("inf")] + [1.0] * 7, 0), (7, [1.0] * 8, None), (8, [1.0] * 8, 0), (9, [2.0] * 8, 0), (10, [1.0] * 8, 1), (11, [1.0] * 9, 0)]
    rows += [(100 + i, [float(np.float32(x)) for x in near_ + rng.normal(size=8) * 0.2], i % 2) for i in range(60)]
    vectors = spark.createDataFrame([r + ("x",) for r in rows], "vec_id long, embedding array<float>, label int, unit string")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_duplicates(vectors).collect()}
    assert found == linked(rows)
    assert embedding_duplicates(vectors.limit(0)).collect() == []
    twins = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in embedding_duplicates(twins).collect()) == [("1", 1, True), ("1", 1, True), ("None", 0, True)]


def test_op10_on_the_whole_table(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op10_embedding_near_dedup"](spark, sf_dir).collect()}
    assert found == linked(rows)
