"""Hard negatives against brute force, on awkward rows and on whole tables."""

import collections
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.llm import hard_negatives as hn
from quillrank.llm.queries import QUERIES, SQL

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id long, label int, embedding array<float>, row string, side string, q string, anchor string"


def mined(rows, every=3, k=5, m=5):
    """Brute force in plain Python: ``COLUMNS`` of all ``(vec_id, label, vector)``."""
    good = [(i, l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = collections.Counter()
    for n, (i, label, v) in enumerate(good):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, l) for o, (j, l, w) in enumerate(good) if o != n)
        for s, j, _ in [x for x in scored if x[2] == label][:k]:
            window = [(-t, o) for t, o, l in scored if l != label and 80 * -s <= 100 * -t <= 100 * -s][:m]
            out.update((i, j, r, o, -s, t) for r, (t, o) in enumerate(window, 1))
    return out


def mine(spark, rows, every=3, **more):
    df = spark.createDataFrame([r + ("x",) * 4 for r in rows], SCHEMA)
    return collections.Counter(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % every == 0, **more).select(*COLUMNS).collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 64, 70), (65, 31, 99), (256, 64, 300)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(shape[0])
    a, b = rng.integers(-(2**28), 2**28, shape[:2]), rng.integers(-(2**28), 2**28, shape[1:])
    assert (hn.strassen(a, b) == a @ b).all()


def test_heaps_merge_in_any_order():
    pick = random.Random(1)
    entries = [(pick.randrange(4), pick.randrange(6), i) for i in range(200)]
    want = [e for s in range(4) for e in sorted((e for e in entries if e[0] == s), key=lambda e: (-e[1], e[2]))[:5]]
    for _ in range(3):
        pick.shuffle(entries)
        heaps = hn.Heaps(4, 5)
        for i in range(0, 200, 33):
            heaps.merge(*(np.array(c) for c in zip(*entries[i : i + 33])))
        assert list(zip(heaps.slot.tolist(), heaps.score.tolist(), heaps.id.tolist())) == want


@pytest.mark.parametrize("seed", range(2))
def test_ties_and_small_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(hn, "BLOCK_A", 7)
    monkeypatch.setattr(hn, "BLOCK_C", 11)
    pick = random.Random(seed)
    rows = [(i - 20, pick.randrange(3), [pick.randrange(-1, 3) / 4 for _ in range(3)]) for i in range(120)]
    assert mine(spark, rows) == mined(rows)


def test_awkward_rows(spark):
    inf, nan = math.inf, math.nan
    v = [0.5, 0.25]
    rows = [
        (None, 1, v), (0, None, v), (3, 1, None), (6, 1, [0.5, None]), (9, 1, [nan, 0.1]), (12, 1, [-inf, 0.1]), (15, 1, []), (18, 2, []),
        (21, 1, v), (21, 1, v), (21, 2, v), (24, 2, v), (1, 1, [0.5]), (2, 3, [0.5, 0.25, 9.0]), (4, 1, [0.0, 0.0]), (5, 2, [-0.5, -0.25]), (27, 5, [1.0, 1.0]), (-3, 1, [-1.0, 2.0]),
    ]
    assert mine(spark, rows) == mined(rows)
    assert mine(spark, []) == mined([])
    assert mine(spark, [(1, 1, v), (2, 2, v)]) == mined([(1, 1, v), (2, 2, v)])


def test_huge_components_have_a_result(spark):
    rows = [(0, 1, [3e38, 0.0]), (1, 1, [3e38, 1.0]), (2, 2, [1e38, -1.0]), (3, 2, [0.5, 1.0])]
    assert [r for r in mine(spark, rows) if r[0] == 0] == [(0, 1, 1, 2, 2**60, 2**60)]


def test_one_label_and_copies_of_one_vector_hold_most_rows(spark):
    rows = [(i, 1 if i % 9 else 2, [0.5, 0.5]) for i in range(400)] + [(1000 + i, i, [i / 100, 0.5]) for i in range(60)]
    assert mine(spark, rows, 50) == mined(rows, 50)


def test_op11_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    found = QUERIES["op11_hard_negatives"](spark, sf_dir)
    want = collections.Counter(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({SQL['op11_hard_negatives']})").fetchall())
    assert want and collections.Counter(tuple(r) for r in found.select(*COLUMNS).collect()) == want
