"""Mixing, language, tokens, licences, personal data, pages and the pipeline."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import awkward, documents, multiset, near, prose, words
from pyspark.sql import functions as F

import corpus_pipeline
from quillrank.llm import bpe, html_extract, language_id, licenses, mixing, pii
from quillrank.llm.queries import QUERIES, SQL

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_mix_targets_and_limits(spark):
    pick = random.Random(1)
    rows = [(i, prose(i, pick.randrange(400)), "en", pick.choice(["b", "a", "a", "a", "é", None])) for i in range(300)] + [(i, t, "en", "a") for i, t in (r[:2] for r in awkward())]
    found = mixing.mix(documents(spark, rows)).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        factor = (total - sum(2 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in order if s not in capped))
        more = {s for s in order if s not in capped and weight[s] * factor > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    target = {s: 2 * sizes[s] if s in capped else weight[s] * factor for s in order}
    by_size = {(s, t) for s, t in ((sizes[s], round(target[s], 6)) for s in order)}
    assert {(r.source_size, round(r.target, 6)) for r in found} == by_size
    assert all(0 <= r.taken <= 2 * r.size for r in found) and len(found) == len(rows)
    taken = collections.Counter()
    for r in found:
        taken[r.source_size] += r.taken
    for s in order:
        assert abs(taken[sizes[s]] - target[s]) <= 2 * mixing.BLOCK
    again = mixing.mix(documents(spark, rows)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mixing.mix(documents(spark, [])).collect() == []


def test_sainte_lague_equals_the_sequential_rule(spark):
    votes = [53, 24, 23, 10, 10, 3, 0]
    for seats in (0, 1, 7, 50):
        quota = [0] * len(votes)
        for _ in range(seats):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * quota[i] + 1), -i))
            quota[best] += 1
        parties = spark.createDataFrame([("g", i, float(v), seats) for i, v in enumerate(votes)], "g string, i int, v double, seats long")
        for group in ([], ["g"]):
            assert [r.quota for r in mixing.sainte_lague(parties, "v", "seats", group, [*group, "i"]).orderBy("i").collect()] == quota


def test_take_mix_gives_the_words_that_mix_counts(spark):
    rows = [(i, prose(i, 40 + i), "en", "ab"[i % 2]) for i in range(60)]
    docs = documents(spark, rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.take_mix(docs)
    assert out.columns == docs.columns
    got = collections.Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        source = iter(words(rows[r.doc_id][1]))
        assert all(w in source for w in words(r.text))  # in order
    assert got == {i: n for i, n in taken.items() if n}


def test_bpe_equals_the_library(own):
    pick = random.Random(2)
    texts = ["", "a" * 700, "ab" * 900 + " x", "   x\x1c\x1d y\x85z\n\n  a", "é" * 400, "don't we'll 123 ½²", "\n" * 500 + "x", "<|endoftext|>", "日本語" * 90, "🎉" * 300]
    texts += ["".join(pick.choice("ethaonis \n\t,.x́‍ \x1f") for _ in range(300)) for _ in range(60)]
    coder = bpe.Bpe(RANKS, public_tokenizers.PATTERN)
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == own.encode_ordinary(text)
        assert coder.decode(ids) == text.encode("utf-8")


def test_bpe_awkward_rows(spark, own):
    docs = documents(spark, awkward())
    found = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), tuple(r.ids), bytes(r.decoded)) for r in found) == sorted((str(i), tuple(own.encode_ordinary(t or "")), (t or "").encode()) for i, t in (r[:2] for r in awkward()))


def token_rows(rows, own):
    out = collections.Counter()
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        out[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    return out


TOKENS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_op4_on_the_whole_table(spark, sf_dir, own):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert multiset(QUERIES["op4_byte_level_bpe"](spark, sf_dir), *TOKENS) == token_rows(rows, own)


def test_language_is_found_without_the_declaration(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 2 = 0").select("text", F.col("lang").alias("declared")))
    held = docs.where("doc_id % 2 = 1")
    found = {r.doc_id: r.lang for r in language_id.identify(held, declared=F.lit(None).cast("string"), model=model).collect()}
    right = [found[r.doc_id] == r.lang for r in held.where("n_chars > 60").collect()]
    assert np.mean(right) > 0.97


def test_evidence_decides_where_the_text_does_not(spark):
    rows = [(i, ("le la les des une est dans " if i % 2 else "the of and is in that ") * 5, "fr" if i % 2 else "en", "fr.site" if i % 2 else "en.site") for i in range(60)]
    rows += [(100, "xx", "en", "en.site"), (101, "xx", None, "fr.site"), (102, "xx", "fr", "fr.site")]
    found = {r.doc_id: r.lang for r in language_id.identify(documents(spark, rows)).collect()}
    assert (found[100], found[101], found[102]) == ("en", "fr", "fr")


def test_language_awkward(spark):
    rows = awkward() + [(30, "12 34 !!"), (31, "йцукен " * 30, None, "a")]
    docs = documents(spark, rows)
    found = language_id.identify(docs).collect()
    assert len(found) == len(rows)
    rejected = {r.doc_id for r in found if not r.accepted}
    assert {1, 2, 3, 30, 31} <= rejected and all(r.lang is None for r in found if not r.accepted)
    left = language_id.drop_unidentified(docs)
    assert left.columns == docs.columns and multiset(left, "doc_id") == collections.Counter((r.doc_id,) for r in found if r.accepted)
    assert {r._key for r in left.collect()} == {"x"}
    assert language_id.identify(documents(spark, [])).collect() == []
    assert [r.accepted for r in language_id.identify(documents(spark, [(1, "some text", None, "a")])).collect()] == [False]


def test_op3_agrees_with_clean_labels(spark, sf_dir):
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = QUERIES["op3_language_id"](spark, sf_dir).collect()
    assert len(found) == len(lang)
    assert all(r.accepted for r in found if re.search("[A-Za-z]{4}", lang[r.doc_id][1]))
    assert np.mean([r.lang == lang[r.doc_id][0] for r in found if r.accepted]) > 0.97


def test_clean_text_of_rare_or_no_languages_is_kept(spark, tmp_path):
    """A language that one row declares, more languages than 64, and no declaration at all."""
    rows = [(i, "the of and is in that %d " % i * 5, "en", "a") for i in range(300)] + [(9_000, "йцукен фывапро " * 30, "ru", "a")]
    rows += [(10_000 + i, "".join(chr(0x4E00 + 50 * i + k) for k in range(40)), f"l{i}", "b") for i in range(100)]
    found = {r.doc_id: r for r in language_id.identify(documents(spark, rows)).collect()}
    assert all(r.accepted for r in found.values()) and found[9_000].lang == "ru"
    assert np.mean([found[10_000 + i].lang == f"l{i}" for i in range(100)]) > 0.97
    model = language_id.fit(documents(spark, rows[:100]).select("text", F.col("lang").alias("declared")))
    assert [r.lang for r in language_id.identify(documents(spark, [rows[300]]), model=model).collect()] == ["ru"]
    odd = [(1, "some text", None, "a"), (2, "йцукен " * 30, None, "a"), (3, "12 34", None, "a"), (4, "½ — €", None, "a"), (5, None, None, "a")]
    documents(spark, odd, False).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.lang for r in QUERIES["op3_language_id"](spark, str(tmp_path)).collect()} == {1: "unknown", 2: "unknown", 3: None, 4: None, 5: None}
    kept = corpus_pipeline.identify_language(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {1, 2}


def test_licences(spark):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and len(t) > 200)
    rows = [
        (201, mit.upper().replace(",", " , ")), (202, "Copyright (c) 2020 A. Person\n\n" + mit.replace("sublicense", "sub-license")), (203, mit + " And more."), (204, "x\nReleased under the MIT Licence\n(released under the mit license!)\ny"),
        (205, "licensed under cc by-nc 4.0"), (206, "Copyright 2020\n(c) Me"), *awkward(),
    ]
    found = licenses.scan_licenses(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: (r.license, r.n_license_lines, r.line_licenses) for r in found}
    # a whole notice on one line counts as a line as well
    assert by_id[201] == ("MIT", 1, "MIT") and by_id[202] == ("MIT", 1, "MIT") and by_id[203] == (None, 0, "")
    assert by_id[204] == (None, 2, "MIT") and by_id[205] == ("CC-BY-NC-4.0", 1, "CC-BY-NC-4.0") and by_id[206] == (None, 0, "")
    assert by_id[7] == (None, 0, "")
    assert licenses.scan_licenses(documents(spark, [])).collect() == []


def test_stock_licence_files_in_their_wrapping(spark):
    import textwrap

    isc, mit = (next(t for i, t in licenses.KNOWN if i == x and len(t) > 200) for x in ("ISC", "MIT"))
    isc_file = "ISC License\n\nCopyright (c) 2020, A. Person\n\n" + isc.replace("that the above copyright", "that the above\ncopyright").replace("copies. THE", "copies.\n\nTHE")
    rows = [(1, isc_file), (2, "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + mit)]
    rows += [(10 + w, "The MIT License (MIT)\nCopyright A. Person\n" + textwrap.fill(mit, w)) for w in range(30, 90)]
    found = {r.doc_id: r.license for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    assert found == {i: "ISC" if i == 1 else "MIT" for i, _ in rows}


def test_op5_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    names = ["doc_id", "license", "n_license_lines", "line_licenses"]
    assert multiset(QUERIES["op5_license_scans"](spark, sf_dir), *names) == collections.Counter(con.execute(f"SELECT {', '.join(names)} FROM ({SQL['op5_license_scans']})").fetchall())


def base(text):
    """The rules of the base spans, written out once more."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(map(int, m[0].split("."))) <= 255:
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(s, e, k) for s, _, k, e in sorted(out)]


PERSONAL = "é a.b@c-d.example.com, 10.0.0.256 10.1.2.3.4 4242 4242 4242 4242 and +1 (743) 555-3824 or +12 x 1234567890123 0010.2.3.4"


def test_base_spans():
    assert pii.base_spans(PERSONAL) == base(PERSONAL)
    pick = random.Random(4)
    for _ in range(300):
        text = "".join(pick.choice("0123456789+ .-()@ab.") for _ in range(80))
        assert pii.base_spans(text) == base(text)


def test_op7_on_the_whole_table(spark, sf_dir):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = QUERIES["op7_pii"](spark, sf_dir).collect()
    assert len(found) == len(text)
    for r in found:
        spans = base(text[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in spans) for x in pii.KINDS]
        listed = [f"{k}:{s}:{e}" for s, e, k in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) or not listed


def test_pii_awkward(spark):
    docs = documents(spark, [*awkward(), (40, PERSONAL), (41, PERSONAL), (41, PERSONAL)])
    found = pii.find_spans(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        if r.doc_id in (40, 41):
            assert [(s.start, s.end, s.kind) for s in r.spans if s.base] == base(PERSONAL)
            assert "a.b@c-d" not in r.redacted and r.redacted.startswith("é <email>, ")
        elif r.doc_id is not None and r.doc_id < 3:
            assert r.spans == [] and r.redacted == ""
    assert pii.find_spans(documents(spark, [])).collect() == []


def test_trees_learn_and_thresholds_add_spans(spark):
    """Where the rule misses a form that the labels support, the trees add it; unlike numbers stay out."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, pii.FEATURES))
    y = ((x[:, 3] > 0) ^ (x[:, 7] > 0.5)).astype(float)
    trees = pii.fit_trees(x[:1000], y[:1000])
    assert np.mean((trees.score(x[1000:]) > 0.5) == y[1000:]) > 0.95
    constant = pii.Trees(5.0, np.zeros((1, 7), int), np.full((1, 7), np.inf), np.zeros((1, 8)))
    added = pii.added_spans("call (743) 555-3824 now", [], constant, {k: 0.9 if k == "phone" else 2.0 for k in pii.KINDS})
    assert [k for *_, k in added] == ["phone"]


def test_other_forms_are_added_by_the_trees(spark):
    """Forms that no rule matches are found where the corpus has their kinds; look-alikes and base spans stay as they are."""
    pick = random.Random(8)
    rows = []
    for i in range(600):
        phone = f"+1 ({pick.randrange(200, 999)}) {pick.randrange(200, 999)}-{pick.randrange(1000, 9999)}"
        ip = ".".join(str(pick.randrange(1, 255)) for _ in range(4))
        rows.append((i, f"{prose(i, 30)} write to {pick.choice('abcdef')}{i}.x@mail{i % 9}.example.org or call {phone} {prose(i + 1, 9)} from {ip} {prose(i + 2, 20)} at home on 2021-03-{i % 28 + 1:02} 10.30 order 12345{i:05}", "en", "s"))
    other = "please write to jane.doe (at) example (dot) com or call 1 (743) 555-3824 from 10[.]1[.]2[.]3 today"
    plain = "we met at noon on 2024-05-17 10.22 with order 1234567890 and version 3.1.2.300 at the place"
    docs = documents(spark, [*rows, (1000, other, "en", "s"), (1001, plain, "en", "s")])
    detector = pii.fit(docs)
    assert max(detector.threshold[k] for k in ("email", "phone", "ip")) <= 1
    found = {r.doc_id: r for r in pii.find_spans(docs, detector).where("doc_id >= 1000").collect()}
    assert found[1000].redacted == "please write to <email> or call <phone> from <ip> today"
    assert found[1001].redacted == plain
    digest = pii.span_digests(docs, detector).where("doc_id = 1000").first()
    assert (digest.n_email, digest.n_phone, digest.base_sha256) == (0, 0, hashlib.sha256(b"").hexdigest()) and digest.spans.count(",") == 2


def test_pii_fit_takes_all_candidates_in_any_order(spark, monkeypatch):
    """Every base span and number of a text teaches, the files of the rows don't matter, and jobs give what the driver gives."""
    pick = random.Random(3)
    numbers = " ".join(f"order {pick.randrange(10**7, 10**9)}" for _ in range(120))
    assert sum(not right for _, right in pii.examples(numbers)) >= 120
    phones = " ; ".join(f"+1 ({pick.randrange(200, 999)}) {pick.randrange(200, 999)}-{pick.randrange(1000, 9999)}" for _ in range(60))
    assert sum(right for _, right in pii.examples(phones)) >= 60
    rows = [(i, f"{prose(i, 12)} call +1 ({pick.randrange(200, 999)}) {pick.randrange(200, 999)}-{pick.randrange(1000, 9999)} or ask a{i}@mail{i % 7}.example.org {prose(i + 1, 9)} order 12345{i:05}", "en", "s") for i in range(200)]
    docs = documents(spark, [*rows, (900, numbers, "en", "s"), (901, phones, "en", "s")])
    monkeypatch.setattr(pii, "TREES", 10)
    local = pii.fit(docs.coalesce(1))
    monkeypatch.setattr(pii, "LOCAL_GROUPS", 0)
    monkeypatch.setattr(pii, "GROUP_ROWS", 50)
    jobs = pii.fit(docs.orderBy(F.desc("doc_id")).repartition(5))
    assert local.threshold == jobs.threshold and min(local.threshold.values()) < 1
    assert all(np.array_equal(a, b) for a, b in zip(local.trees, jobs.trees))


def test_pii_time_is_linear():
    for part in ("1", "a", "+1", "1.", "1 "):
        text = part * (1_000_000 // len(part)) + "@"
        assert isinstance(pii.base_spans(text) + pii.candidates(text), list)
    assert pii.base_spans("0" * 5000 + "1.2.3.4") == [(0, 5007, "ip")]


PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site">Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use</div><!-- x -->
<div class="ad">Buy &amp; win</div><article><header><h1>Head &amp;\n line</h1></header><p><b>First&nbsp;bold<br>more<p>Second %s</p><ul><li>one<li>two</ul>
<form><input value="x">Send</form><aside>Side</aside><div id="comments"><p>Nice</p></div></article><div class="sidebar">S</div><footer>&copy; F</footer></body></html>"""


def test_page_text():
    assert html_extract.main_text(html_extract.parse(PAGE % "x"), {}) == "Head & line\n\nFirst bold more\n\nSecond x\n\none\n\ntwo"
    for broken in ("", "<", "<p", "plain", "<article><p>a", "</p></div>b", "<div>" * 5000 + "deep"):
        assert html_extract.main_text(html_extract.parse(broken), {}).endswith(re.sub("<[^>]*>?", "", broken)[-1:] or "")


def test_names_of_whole_pages_are_no_frame():
    for page in ('<body class="no-sidebar"><p>a</p></body>', '<body class="has-menu menu"><p>a</p>', '<div class="content no-sidebar"><p>a</p></div><div class="left-sidebar">b</div>'):
        assert html_extract.main_text(html_extract.parse(page), {}) == "a"


def test_site_frame_is_learnt_from_the_site(spark):
    """Without telling tags or classes, what all pages of a host repeat is cut, and what differs stays."""
    page = "<body><div class=upper><p>Same line on all pages</p></div><div class=lower><p>Own text {0} of this page</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(40)] + [(100, None, None), (101, "http://[bad", page.format(101)), (102, "http://other.example/", page.format(102)), (None, "", "")]
    pages = spark.createDataFrame([r + ("x",) for r in rows], "page_id long, url string, html string, host string")
    found = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert all(found[i] == f"Own text {i} of this page" for i in range(40))
    assert found[100] == found[None] == "" and found[101].startswith("Same") and found[102].startswith("Same")
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_names_fall_before_the_article():
    """Named branches stay that hold the marked article or most of the text; frames beside it, and comments, go."""
    for page in (
        "<body><form id=aspnetForm><nav>menu</nav><p>Body text</p></form>",
        '<div class="content-sidebar-wrap"><p>Body text</p></div><div class=sidebar>x</div>',
        '<div class="post category-social"><p>Body text</p></div>',
        '<div class="nav-wrapper"><article>Body text</article></div><div class=menu>menu</div>',
        '<div class=sidebar><article>tease</article></div><div class=t><p>Body text</p></div>',
        '<article class="post">Body text</article><div id=comments><article class="comment">A much longer comment by a reader</article></div>',
        '<main><article>Body text</article><article class="comment">A much longer comment by a reader</article></main>',
    ):
        assert html_extract.main_text(html_extract.parse(page), {}) == "Body text", page
    title = '<article><header class="entry-header"><h1>Title</h1></header><p>Body text</p></article>'
    assert html_extract.main_text(html_extract.parse(title), {}) == "Title\n\nBody text"


def test_deep_and_unclosed_pages_end():
    for part in ("<div>", "<h1>", "<p><section>", "</b></div></p>"):
        assert html_extract.main_text(html_extract.parse(part * 100_000 + "x"), {}).endswith("x")


def test_blocks_are_judged_by_their_own_content(spark):
    """Unique paragraphs stay beside longer shared ones, shared notices go, loosely named branches stay if they matter."""
    shared = "A longer paragraph that all the pages of this host show in the very same form. " * 4
    article = "<article><h1>Title {0}</h1><p>Own paragraph {0}.</p><p>" + shared + "</p></article>"
    plain = "<div class=a><p>Subscribe to our letter</p><div class=b>Front {0}</div><p>Own words {0}</p></div><div class=c>Terms of use</div>"
    widget = '<div class="elementor-widget"><p>Own words of page {0}</p></div><div class="elementor-widget k"><p>Call us today</p></div><div class=x>Rest {0}</div>'
    copies = "<article><h1>Copy</h1><p>One text on many addresses</p></article>"
    rows = [(i, f"http://{host}.example/{i}", page.format(i)) for k, (host, page) in enumerate([("a", article), ("b", plain), ("w", widget), ("c", copies)]) for i in range(100 * k, 100 * k + 40)]
    rows += [(500 + i, f"http://c.example/{i}", article.format(i)) for i in range(3)]
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(40):
        assert found[i] == f"Title {i}\n\nOwn paragraph {i}."
        assert found[100 + i] == f"Front {100 + i}\n\nOwn words {100 + i}"
        assert found[200 + i] == f"Own words of page {200 + i}\n\nRest {200 + i}"
        assert found[300 + i] == "Copy\n\nOne text on many addresses"
    assert all(shared.strip() in found[500 + i] for i in range(3))


def test_op8_lists_beyond_the_broadcast(spark, monkeypatch):
    page = "<div><p>Same line on all pages</p><p>Own text {0}</p></div>"
    rows = [(i, "http://h.example/", page.format(i % 30)) for i in range(90)] + [(None, "http://h.example/", page.format(5))] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = multiset(html_extract.extract(pages), "page_id", "text")
    monkeypatch.setattr(html_extract, "SMALL_LISTS", 1)
    monkeypatch.setattr("quillrank.sizing.SMALL_ROWS", 1)
    assert multiset(html_extract.extract(pages), "page_id", "text") == want
    assert want[(None, "Own text 5")] == 3 and want[(7, "Own text 7")] == 1


def test_op8_stores_few_files_however_many_partitions(spark, monkeypatch):
    """Each file that a task stores has its executor start processes, so what is read once is not stored a file a partition."""
    page = "<div><p>Same line on all pages</p><p>Own text {0}</p><p>Own end {0}</p></div>"
    rows = [(i, f"http://h{i % 7}.example/", page.format(i % 50)) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    stored = []
    store = html_extract.materialize
    monkeypatch.setattr(html_extract, "materialize", lambda df, label="stage": stored.append(store(df, label)) or stored[-1])
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = multiset(html_extract.extract(pages), "page_id", "text")
        assert sum(len(df.inputFiles()) for df in stored) < 80
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {(i, f"Own text {i % 50}\n\nOwn end {i % 50}"): 1 for i in range(400)}


def test_op8_on_the_whole_table(spark, sf_dir):
    import html

    found = {r.page_id: r for r in QUERIES["op8_html_extraction"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search("<article>(.*?)(</article>|$)", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert (found[r.page_id].text, found[r.page_id].url) == ("\n\n".join(b for b in blocks if b), r.url)
        assert found[r.page_id].n_chars == len(found[r.page_id].text)


def test_pipeline(spark, sf_dir, own):
    """Each stage on its own input against what it must do, and the last one against the library."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        rows[name] = (before, docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = rows["language_id"]
    assert {r.doc_id for r in before if re.search("[A-Za-z]{4}", r.text)} <= {r.doc_id for r in after}
    before, after = rows["exact_dedup"]
    last = {}
    for r in before:
        last[r.text] = max(r.doc_id, last.get(r.text, r.doc_id))
    assert {r.doc_id for r in after} == set(last.values())
    before, after = rows["minhash_near_dedup"]
    assert {r.doc_id for r in after} == {i for i, (_, c) in near([(r.doc_id, r.text) for r in before]).items() if i == c}
    before, after = rows["mixing"]
    want = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    got = collections.Counter()
    for r in after:
        got[r.doc_id] += len(words(r.text))
    assert got == {i: n for i, n in want.items() if n}
    before, after = rows["byte_level_bpe"]
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after) == token_rows([(r.doc_id, r.text) for r in before], own)
