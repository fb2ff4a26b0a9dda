"""Chunked byte-level BPE against the tokenizers library, on awkward rows and on whole tables."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
from helpers import awkward, documents, multiset, prose
from tokenizers import Tokenizer

from quillrank.llm import chunk_bpe as cb
from quillrank.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'", "r", "e", "'re", "'ll", " ", "  ", "\n", "\n\n", "\t", "1", "99", "é", "日", "本", "<|endoftext|>", "<|endof", "text|>", "!", "...", "x" * 50, " " * 60, "՘", "\xa0", "\x1c", "\x85", "😀", "a"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    with open(PATH, encoding="utf-8") as f:
        return cb.ChunkCoder(f.read())


def coded(library, rows):
    """Brute force: each whole text by the library; ids and decoded text of every row."""
    ids = {t: library.encode(t, add_special_tokens=False).ids for _, t in rows for t in [t or ""]}
    return collections.Counter((i, tuple(ids[t or ""]), library.decode(ids[t or ""], skip_special_tokens=False)) for i, t in rows)


def found(spark, rows):
    out = cb.encode_decode(documents(spark, rows), PATH).collect()
    return collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in out)


def test_pieces_equal_the_librarys_for_every_settled_character(library, coder):
    settled = [chr(c) for c in [*range(1, 0x530), *range(0x2010, 0x2028)]]
    for a in range(0, len(settled), 50):
        text = "".join(f"a1!{c}a1!x 1{c}1 {c} a{c}" for c in settled[a : a + 50])
        assert coder.unsettled(text) is None
        assert coder.find(text) == [text[x:y] for _, (x, y) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_chunks_cover_texts_and_meet_again_after_an_insertion(coder):
    text = prose(1, 20_000, 5_000).encode()
    for t in (text, text[5:], b"new words " + text, "日本".encode() * 9_000, b"a" * 30_000, b"x"):
        assert b"".join(coder.chunks(t)) == t
        assert all(0 < len(c) <= cb.MOST and c.decode() for c in coder.chunks(t))
    a, b = list(coder.chunks(text)), list(coder.chunks(b"new words " + text))
    assert len(set(a) & set(b)) > 0.9 * len(a)


@pytest.mark.parametrize("seed", range(4))
def test_joins_agree_with_the_library(library, coder, monkeypatch, seed):
    """Tiny chunks, so that joins fall everywhere: in contractions, runs of white space, long words, added tokens."""
    for name, value in (("LEAST", 8), ("MOST", 40), ("CUT_BITS", 3), ("AHEAD", 4)):
        monkeypatch.setattr(cb, name, value)
    pick = random.Random(seed)
    for _ in range(300):
        text = "".join(pick.choice(PARTS) for _ in range(pick.randrange(120)))
        assert coder.encode_text(text.encode(), coder.encode).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_texts_of_a_batch_are_encoded_together(library, coder, monkeypatch):
    """One call for all chunks and one for all joins between them, however many there are."""
    calls = []
    monkeypatch.setattr(coder, "encode_all", lambda texts, f=coder.encode_all: calls.append(len(texts)) or f(texts))
    texts = [prose(seed, 2_000, 10_000) for seed in range(20)] + ["", "<|endoftext|>", "日本 " * 900 + "<|endoftext|>x"]
    out = coder.encode_texts([t.encode() for t in texts], coder.encode_all)
    assert [x.tolist() for x in out] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(calls) > 300 and len(calls) < 10


def test_packets_keep_what_is_coded(coder):
    code = coder.encode("Hello there,  it's\n日本".encode())
    again = cb.Coded.unpack(code.pack())
    assert all((x == y).all() for x, y in ((code.ids, again.ids), (code.first, again.first), (code.begin, again.begin)))


def test_memory_that_starts_anew(library, coder, monkeypatch):
    monkeypatch.setattr(cb, "REMEMBER", 50)
    for seed in range(5):
        text = prose(seed, 300, 10_000)
        assert coder.encode_text(text.encode(), coder.encode).tolist() == library.encode(text, add_special_tokens=False).ids


def test_awkward_rows(spark, library):
    rows = [r[:2] for r in awkward()] + [(20, "a<|endoftext|>b <|endoftext|>"), (21, "<|endoftext|>"), (22, "y" * 9_000), (22, "y" * 9_000), (23, prose(9, 2_000) + " 1"), (24, "2 " + prose(9, 2_000))]
    assert found(spark, rows) == coded(library, rows)
    assert found(spark, []) == collections.Counter()


def test_one_text_and_one_row_hold_most_rows(spark, library):
    text = prose(3, 900)
    rows = [(7, text)] * 150 + [(i, text) for i in range(150)] + [(1000 + i, text + prose(i, 50)) for i in range(50)] + [(2000 + i, prose(100 + i, 60)) for i in range(50)]
    assert found(spark, rows) == coded(library, rows)


def test_other_tokenizers_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        cb.ChunkCoder(f.read())


def test_op12_on_the_whole_table(spark, sf_dir, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = collections.Counter({(i, len(ids), sha(",".join(map(str, ids))), sha(t)): n for (i, ids, t), n in coded(library, rows).items()})
    assert multiset(QUERIES["op12_chunked_bpe"](spark, sf_dir), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
