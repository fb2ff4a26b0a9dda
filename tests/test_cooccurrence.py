"""Documents that hold both terms of a pair, against plain sets."""

import random

import numpy as np
import pytest

from quillrank.operators import joins


def met(postings, pairs):
    """Brute force: in how many documents both terms of each pair are."""
    docs = {}
    for d, t in postings:
        docs.setdefault(t, set()).add(d)
    both = {(a, b): len(docs.get(a, set()) & docs.get(b, set())) for a, b in pairs}
    return {p: n for p, n in both.items() if n}


@pytest.mark.parametrize("max_pairs", [10_000, 3])
def test_shared_documents_of_pairs(spark, max_pairs):
    pick = random.Random(max_pairs)
    postings = [(d, t) for d in range(3_000) for t in ("all", "none" if d % 2 else "odd", f"w{pick.randrange(40)}", f"r{pick.randrange(2_000)}")]
    postings = list(dict.fromkeys(postings)) + [(7, "all"), (-1, "all"), (-1, "w1")]
    terms = ["all", "none", "odd", "absent", *(f"w{i}" for i in range(8)), *(f"r{i}" for i in range(8))]
    pairs = [(a, b) for a in terms for b in terms] + [("all", "odd")] * 2
    frame = spark.createDataFrame(postings, "doc_id bigint, term string")
    found = joins.cooccurrence(frame, spark.createDataFrame(pairs, "t1 string, t2 string"), max_pairs=max_pairs).collect()
    if max_pairs == 3:  # by rows a term is no partner of its own
        found, pairs = [r for r in found if r.t1 != r.t2], [p for p in pairs if p[0] != p[1]]
    assert {(r.t1, r.t2): r.n for r in found} == met(postings, pairs) and len(found) == len({(r.t1, r.t2) for r in found})


def test_no_pairs_and_no_postings(spark):
    none, one = spark.createDataFrame([], "doc_id bigint, term string"), spark.createDataFrame([("a", "b")], "t1 string, t2 string")
    assert joins.cooccurrence(none, one).collect() == []
    assert joins.cooccurrence(spark.createDataFrame([(1, "a")], none.schema), one.limit(0)).collect() == []


def test_a_pair_costs_what_its_rarer_term_has(monkeypatch):
    """Entries that are looked at: the documents of the rarer term, or the words of a bitmap if those are fewer."""
    n, seen = 6_400, []
    term = np.concatenate([np.zeros(n, int), np.ones(3, int), np.full(900, 2)])
    doc = np.concatenate([np.arange(n), [5, 70, 6_399], np.arange(900) * 7])
    monkeypatch.setattr(joins.np, "repeat", lambda a, size, f=np.repeat: seen.append(int(np.sum(size))) or f(a, size))
    assert joins.shared_counts(term, doc, 3, n, np.array([0, 1, 2]), np.array([1, 2, 0])).tolist() == [3, len({5, 70, 6_399} & set(range(0, 6_300, 7))), 900]
    assert max(seen) == 3 + 3  # pairs 0-1 and 1-2 by the three documents of term 1, pair 2-0 by bitmaps
