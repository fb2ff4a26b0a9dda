"""Text functions and the stemmer."""

import itertools
import random

import duckdb
import pytest
from porter import porter
from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.functions.stemming import stem_sql, stem_terms, stem_words

STATUS_CASES = [
    ("Hello, World!", ["hello", "world"]),
    ("@JohnDoe likes #BigData", ["@johndoe", "likes", "#bigdata"]),
    ("see http://Example.com/A?b=C now", ["see", "http://Example.com/A?b=C", "now"]),
    ("(http://t.co/Xy", ["http://t.co/Xy"]),
    ("AT&T and a&b", ["att", "and", "a", "b"]),
    ("U.S. foo.bar wait...", ["us", "foo", "bar", "wait"]),
    ("RT@user: hi", ["rt", "user", "hi"]),
    ("snake_case don't", ["snake", "case", "dont"]),
    ("#tag, @me! #1", ["#tag", "@me", "1"]),
    ("well-known café…", ["well", "known", "café"]),
    ("  ", []),
]


@pytest.mark.parametrize("text,expected", STATUS_CASES)
def test_status_tokens(spark, text, expected):
    df = spark.createDataFrame([(text,)], "text STRING")
    assert df.select(tx.status_tokens("text")).first()[0] == expected


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v STRING").select(column).first()[0]


def test_html_to_text(spark):
    html = "<html><style>p{}</style><SCRIPT src=x>var a='<p>';</SCRIPT><!-- no\nno --><p>Tom &amp; <b>Jerry</b>\n\n&lt;3</p></html>"
    assert one(spark, html, tx.html_to_text("v")) == "Tom & Jerry <3"


def test_urls_dates_counts(spark):
    assert one(spark, "https://www.x.org:80/a", tx.url_domain("v")) == "x.org"
    assert one(spark, "not a url at all", tx.url_domain("v")) is None
    assert one(spark, "Fri Mar 04 10:11:12 +0000 2011", tx.to_epoch("v")) == 1299233472
    assert one(spark, "yesterday", tx.to_epoch("v")) is None
    assert one(spark, "100+", tx.parse_count("v")) == 100
    assert one(spark, "many", tx.parse_count("v")) is None
    assert one(spark, "a#b##", tx.count_substr("v", "#")) == 3
    assert one(spark, "a\r\n\nb", tx.fold_newlines("v")) == "a b"
    assert one(spark, '{"a": {"b": 1}}', tx.get_json("v", "$.a.b")) == "1"
    assert one(spark, "{}", tx.get_json("v", "$.a.b", "none")) == "none"


def test_english_stop_words(spark):
    assert one(spark, "The cat is ON the mat", tx.english_tokens("v")) == ["cat", "mat"]
    assert one(spark, "the cat  the mat", tx.remove_stopwords("v", ["the"])) == "cat mat"


# Examples given in Porter (1980), after all steps.
PORTER = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
    "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi",
    "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit",
    "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam",
    "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic",
    "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop",
    "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust",
    "dependent": "depend", "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ",
    "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll",
}


def stems(spark, words):
    frame = spark.createDataFrame([(w,) for w in words], "term string")
    return {r.term: r.stem for r in stem_terms(frame).collect()}


def test_porter_examples(spark):
    assert {w: porter(w) for w in PORTER} == PORTER
    assert stems(spark, PORTER) == PORTER


def invented():
    """Words of all endings behind stems of all shapes, and words of few letters in any order."""
    from quillrank.functions.stemming import STEP2, STEP3, STEP4

    ends = [*STEP2, *STEP3, *STEP4, "sses", "ies", "ss", "s", "eed", "ed", "ing", "y", "e", "ll", "le", "ation", "ational"]
    shapes = ["", "t", "tr", "a", "ay", "tay", "y", "yy", "hyy", "ayy", "ayyy", "oat", "abet", "trouble", "syzyg", "crepus", "fall", "hopp", "fizz", "how", "box", "gat", "sobl", "siz", "yet", "yoyo", "qui"]
    pick = random.Random(3)
    loose = ["".join(pick.choice("aeiouybstlnz") for _ in range(pick.randrange(1, 9))) for _ in range(4_000)]
    return sorted({a + b + c for a, b, c in itertools.product(shapes, ends, ("", "s", "ed", "ly"))} | set(loose))


def test_stems_equal_the_plain_stemmer_in_both_engines(spark):
    words = invented()
    want = {w: porter(w) for w in words}
    got = stems(spark, words)
    assert [w for w in words if got[w] != want[w]] == []
    text = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    assert duckdb.connect().execute(f"SELECT {stem_sql('w')} FROM (SELECT {text} AS w)").fetchone()[0] == [want[w] for w in words]


def test_stemming_keeps_what_is_no_word(spark):
    kept = ["#running", "@cats", "http://x.org/cats", "cats9", "is", "", "Cats", "caféing", "a\nbs", "b.", "x|", "cats.\n"]
    assert stems(spark, kept) == {w: w for w in kept}
    frame = spark.createDataFrame([(["running", None, "cats"],), (None,), ([],)], "words array<string>")
    assert [r[0] for r in frame.select(stem_words(F.col("words"))).collect()] == [["run", None, "cat"], None, []]


def test_analyzer_is_a_parameter(spark):
    from quillrank.operators.postings import build_postings

    docs = spark.createDataFrame([(1, "a|b|a")], "doc_id BIGINT, text STRING")
    rows = build_postings(docs, analyzer=lambda c: F.split(c, r"\|")).collect()
    assert {(r.term, r.tf, tuple(r.positions)) for r in rows} == {("a", 2, (0, 2)), ("b", 1, (1,))}


def test_character_references_in_page_text(spark):
    cases = {
        "<p>it&#8217;s &#x2019; &copy; &eacute;&uuml;</p>": "it’s ’ © éü",
        "&#38;amp; &amp;lt; &#38;#39;": "&amp; &lt; &#39;",
        "&#xZ; &#99999999; &#55296; a&#": "&#xZ; &#99999999; &#55296; a&#",
        "&#128512;&#0;": "😀&#0;",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "html string")
    assert {r.html: r.text for r in frame.select("html", tx.html_to_text("html").alias("text")).collect()} == cases
