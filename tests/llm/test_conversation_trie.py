"""The prefix trie of conversations against a plain trie in Python, on awkward rows and on whole tables."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quillrank.llm import conversation_trie as ct
from quillrank.llm.queries import QUERIES, SQL

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, n long, depth long, digest string, start long"


def tries(rows, heads=True):
    """Brute force: ``COLUMNS`` of every node of ``(conv_id, turn, role, text)``."""
    own = collections.defaultdict(list)
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    whole = dict(own)
    if heads:
        for c in own:
            h = zlib.crc32(str(c).encode()) % 6
            donor = c - (c % 100 if c >= 0 else -(-c % 100))
            whole[c] = own.get(donor, [])[:h] + own[c][h:]
    members = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return collections.Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def trie(spark, rows, heads=True):
    df = spark.createDataFrame([r + (1, 2, "x", 3) for r in rows], SCHEMA)
    more = (F.crc32(F.col("conv_id").cast("string")) % 6, F.col("conv_id") - F.col("conv_id") % 100) if heads else ()
    return collections.Counter(tuple(r) for r in ct.conversation_trie(df, *more).select(*COLUMNS).collect())


def branching(seed, n, depth):
    """Conversations that leave each other at all depths, inside blocks and at their borders."""
    pick = random.Random(seed)
    whole, rows = [[]], []
    for c in range(n):
        base = pick.choice(whole)
        turns = base[: pick.choice([0, 1, 7, 8, 9, 16, len(base)])] + [(pick.choice(["user", "assistant"]), "w" * pick.randrange(4)) for _ in range(pick.randrange(depth))]
        whole.append(turns)
        rows += [(3 * c - 40, i, *t) for i, t in enumerate(turns)]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "heads"), [(0, True), (1, False), (2, False)])
def test_branching_conversations(spark, seed, heads):
    rows = branching(seed, 60, 12)
    assert trie(spark, rows, heads) == tries(rows, heads)


def test_pieces_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(ct, "PIECE", 16)
    monkeypatch.setattr(ct, "PACKET", 3)
    rows = branching(5, 25, 40)
    assert trie(spark, rows, False) == tries(rows, False)


def test_a_long_chain_of_conversations_that_hang_on_each_other(spark):
    rows = [(c, d, "user", "aé日"[d % 3] * (d % 4)) for c in range(12) for d in range(2 * c)] + [(c, 2 * c, "assistant", "end") for c in range(12)]
    assert trie(spark, rows, False) == tries(rows, False)


def test_awkward_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (1, None, None, None), (1, None, "user", "x"), (1, 3, "user", ""), (1, 3, "user", ""), (1, 2, None, "x"), (2, 0, "user", "tie a"), (2, 0, "user", "tie b"), (2, 0, "bot", "tie"),
        (100, 0, "u", "only"), (101, 0, "u", "gone"), (155, 0, "u", "a"), (155, 1, "u", "b"), (155, 2, "u", "c"), (155, 3, "u", "d"), (155, 4, "u", "e"), (155, 5, "u", "f"), (-7, 0, "u", "n"), (-250, 1, "u", "m"), (205, 1, "u", "no donor"),
        (300, 0, "user", "y" * 300_000), (302, 0, "user", "y" * 300_000), (303, 0, "us", "er"), (304, 0, "use", "r"),
    ]
    assert trie(spark, rows) == tries(rows)
    assert trie(spark, rows, False) == tries(rows, False)
    assert trie(spark, []) == collections.Counter()


def test_one_conversation_and_one_text_hold_most_rows(spark):
    rows = [(1, i // 7, "user", "same") for i in range(300)] + [(c, d, "user", f"turn {d}") for c in range(2, 150) for d in range(2)] + [(c, 0, "user", f"own {c}") for c in range(150, 200)]
    assert trie(spark, rows) == tries(rows)


def test_op13_equals_its_sql_and_brute_force(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = collections.Counter(tuple(r) for r in QUERIES["op13_conversation_trie"](spark, sf_dir).select(*COLUMNS).collect())
    assert got == collections.Counter(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({SQL['op13_conversation_trie']})").fetchall())
    assert got == tries(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall())
