"""Small tables with awkward rows, and brute-force versions of what operators do."""

import collections
import random
import re

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators must not trip over.
CLASHING = ["_key", "part", "key", "rep", "row", "bytes", "host", "size", "target", "interval", "tag", "packet", "kept", "n", "best", "unit"]


def documents(spark, rows, clashing=True):
    """``rows`` are ``(doc_id, text, lang, source)``; shorter ones are filled up."""
    full = [(r + (None, "en", "a")[len(r) - 1 :] if len(r) < 4 else r) for r in rows]
    full = [(a, b, c, d, None if b is None else len(b)) for a, b, c, d in full]
    extra = CLASHING if clashing else []
    schema = DOCUMENT + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([r + ("x",) * len(extra) for r in full], schema)


def prose(seed, n, words=400):
    pick = random.Random(seed)
    return " ".join("w%d" % pick.randrange(words) for _ in range(n))


def awkward():
    """Nulls, blanks, repeated rows, ties, a null id and a very long text."""
    base = prose(1, 120)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four five six"), (6, base), (7, base), (7, base), (8, base + " end"),
        (9, prose(2, 60_000, 5_000)), (None, base), (None, "alone here"), (10, "Ünï ŝhort\x1ctext\xa0x"), (11, "ONE two\x0bTHREE four FIVE six"), (12, prose(3, 36)), (13, prose(3, 36)),
    ]


def words(text):
    return (text or "").encode("utf-8").split()


def shingles(text):
    w = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "").encode("utf-8").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(ids, links):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def near(rows):
    """``doc_id -> (n_shingles, component)`` for unique ids, by comparing all documents that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    common = collections.Counter((a, b) for h in holders.values() for a in h for b in h if a < b)
    links = [p for p, c in common.items() if 100 * c >= 85 * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    least = components(sets, links)
    return {i: (len(s), least[i]) for i, s in sets.items()}


def multiset(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())
