"""Readers on hand-made files."""

import bz2
import gzip
import json

import pytest
from pyspark.sql import Observation

from quillrank.operators import filters as fl
from quillrank.operators.postings import upsert
from quillrank.sinks.files import run_lines, write_stoplist
from quillrank.sources import judgments as jd
from quillrank.sources import records as rc
from quillrank.sources import statuses as st
from quillrank.sources import topics as tp


def gz(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()))


def warc_record(version, kind, doc_id, payload):
    head = f"{version}\r\nWARC-Type: {kind}\r\nWARC-TREC-ID: {doc_id}\r\nWARC-Target-URI: http://x.org/{doc_id}\r\n"
    return f"{head}Content-Length: {len(payload.encode())}\r\n\r\n{payload}\r\n\r\n"


@pytest.mark.parametrize("version,content", [("WARC/1.0", "<p>Héllo WARC text</p>"), ("WARC/0.18", "\r\n<p>Héllo WARC text</p>")])
def test_warc(spark, tmp_path, version, content):
    page = "HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n<p>Héllo WARC text</p>"
    good = warc_record(version, "response", "d1", page) + warc_record(version, "warcinfo", "d0", "Content-Length: 1\nplain")
    gz(tmp_path / "deep" / "er" / "a.warc.gz", good)
    gz(tmp_path / "OtherData" / "b.warc.gz", warc_record(version, "response", "other", page))
    (tmp_path / "notes.txt").write_text("no records")
    rows = {r.doc_id: r for r in rc.read_warc(spark, str(tmp_path), version).collect()}
    assert set(rows) == {"d1", "d0"}
    assert rows["d1"].content == content and rows["d1"].url == "http://x.org/d1"
    assert rows["d0"].content == "plain" and rows["d0"].headers["WARC-Type"] == "warcinfo"
    assert [r.doc_id for r in fl.only_responses(rc.read_warc(spark, str(tmp_path), version)).collect()] == ["d1"]


def test_warc_records_are_walked_by_their_length():
    """However the bytes are cut into batches of lines, the records are the same, and each takes one step."""
    pages = [(f"d{i}", "Content-Length: 1\n" + "WARC/1.0\r\n\r\nx\n" * (i % 4) + "y" * (i % 7)) for i in range(12)]
    data = "".join(warc_record("WARC/1.0", "response", k, p) for k, p in pages).encode()
    data += b"junk\nWARC/1.0\r\nno length\r\n\r\nWARC/1.0\r\nContent-Length: x\n\nWARC/1.0\nCONTENT-LENGTH:  3 \r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 50\n\ncut"
    lines = (data + b"\n").split(b"\n")[:-1]
    for step in (1, 2, 5, len(lines)):
        walker = rc._Walker("WARC/1.0")
        found = [r for i in range(0, len(lines), step) for r in walker.feed(b"\n".join(lines[i : i + step]) + b"\n")]
        found += walker.feed(b"", last=True)
        assert [(p.decode(), bad) for _, p, bad in found] == [(p, False) for _, p in pages] + [("", True), ("", True), ("abc", False), ("cut\n", True)]


def test_warc_payload_may_hold_any_text_and_bytes(spark, tmp_path):
    inner = "Content-Length: 1\n<p>WARC/1.0</p>\nWARC/1.0\r\nWARC-Type: response\r\n\r\n<p>x</p>"
    latin = b"WARC/1.0\r\nWARC-TREC-ID: d3\r\nWARC-Type: response\r\nContent-Length: 29\r\n\r\nContent-Length: 1\n<p>caf\xe9</p>\n"
    cut = b"WARC/1.0\r\nWARC-TREC-ID: d4\r\nContent-Length: 99\r\n\r\nshort"
    data = (warc_record("WARC/1.0", "response", "d1", inner) + warc_record("WARC/1.0", "response", "d2", "Content-Length: 1\n<p>fine</p>")).encode() + latin + cut
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    gz(tmp_path / "b.warc.gz", warc_record("WARC/1.0", "response", "e1", "Content-Length: 1\n<p>b</p>"))
    found = {r.doc_id: r.content for r in rc.read_warc(spark, str(tmp_path)).collect()}
    assert found == {"d1": inner.split("\n", 1)[1], "d2": "<p>fine</p>", "d3": "<p>caf\ufffd</p>", "e1": "<p>b</p>"}
    assert [r.doc_id for r in rc.read_warc(spark, str(tmp_path), with_rejects=True).where("rejected").collect()] == ["d4"]


def test_stop_list_is_written_whole(spark, tmp_path):
    write_stoplist(spark.range(500).selectExpr("concat('t', id) AS term"), str(tmp_path / "stop"))
    assert jd.read_stoplist(spark, str(tmp_path / "stop")).count() == 500


def test_run_file_is_in_numeric_topic_order(spark):
    run = spark.createDataFrame([(q, 1, 1.0, 1) for q in ("10", "9", "MB2", "100")], "qid string, doc_id long, score double, rank int")
    assert [r.value.split()[0] for r in run_lines(run, "t").collect()] == ["9", "10", "100", "MB2"]


def test_blank_texts_are_empty(spark):
    docs = spark.createDataFrame([(1, "\n\t \x01"), (2, " a\t"), (3, None), (4, "")], "doc_id long, text string")
    assert [r.doc_id for r in fl.drop_empty(docs).collect()] == [2]


def test_upsert_takes_the_last_version(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, version int")
    new = spark.createDataFrame([(1, "late", 3), (1, "early", 1), (3, "c", 1)], "id long, v string, version int")
    assert sorted(tuple(r)[:2] for r in upsert(base, new, version="version").collect()) == [(1, "late"), (2, "b"), (3, "c")]
    assert upsert(base, new).count() == 3


def test_vectors_keep_lines_of_one_value(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 1\nred 0.5\nblue 0.25\n")
    assert {r.term: list(r.embedding) for r in jd.read_vectors(spark, str(tmp_path / "v.txt")).collect()} == {"red": [0.5], "blue": [0.25]}


def test_trec_web(spark, tmp_path):
    text = (
        "<DOC>\n<DOCNO> GX1 </DOCNO>\n<DOCHDR>\nhttp://x\n</DOCHDR>\n  <b>one</b>  \n two\n</DOC>\n"
        "<DOC>\n<DOCHDR>\nhttp://y\n</DOCHDR>\nno number\n</DOC>\n"
    )
    gz(tmp_path / "00.gz", text)
    rows = rc.read_trec_web(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.content, r.type) for r in rows] == [("GX1", "<b>one</b> two", "response")]
    assert rc.read_trec_web(spark, str(tmp_path), with_rejects=True).where("rejected").count() == 1


def test_empty_pages_are_counted(spark, tmp_path):
    pages = "".join(warc_record("WARC/1.0", "response", f"d{i}", f"Content-Length: 1\n<p>{t}</p>") for i, t in enumerate(["a", " ", "b"]))
    gz(tmp_path / "a.warc.gz", pages)
    seen = Observation("pages")
    docs = fl.drop_empty(rc.read_warc(spark, str(tmp_path)).selectExpr("doc_id", "regexp_replace(content, '<[^>]*>', '') AS text"), counted=seen)
    assert docs.count() == 2
    assert seen.get == {"n_rows": 3, "n_empty": 1}


STATUS = {
    "id": 10, "text": "hi", "created_at": "Fri Mar 04 10:11:12 +0000 2011", "retweet_count": "100+", "lang": None,
    "user": {"id_str": "7", "screen_name": "u", "location": "L", "followers_count": 5, "friends_count": 6, "statuses_count": 7},
    "place": {"full_name": "Chicago, IL"}, "coordinates": {"coordinates": [-87.65, 41.85]},
    "retweeted_status": {"id": 9, "user": {"id": 8}}, "entities": {"urls": [{"expanded_url": "http://www.x.org/a"}]},
}


def test_statuses(spark, tmp_path):
    lines = [json.dumps(STATUS), "{}", '{"id": 11, "text": "cut', json.dumps({"id": 12, "text": "bare"}), json.dumps({"id": 13}), ""]
    gz(tmp_path / "s.gz", "\n".join(lines))
    rows = {r.id: r for r in st.read_statuses(spark, str(tmp_path)).collect()}
    assert set(rows) == {10, 12}
    r = rows[10]
    assert (r.epoch, r.place, r.longitude, r.latitude, r.retweet_count) == (1299233472, "Chicago, IL", -87.65, 41.85, 100)
    assert (r.retweeted_status_id, r.retweeted_user_id, r.lang, r.urls) == (9, 8, "unknown", ["http://www.x.org/a"])
    bare = rows[12]
    assert bare.epoch is None and bare.longitude is None and bare.retweet_count is None and bare.place is None


def test_statuses_by_pattern(spark, tmp_path):
    for name in ("2011-a.gz", "one/2012-b.gz", "one/two/2011-c.gz", "2013-d.gz"):
        gz(tmp_path / name, json.dumps({"id": len(name), "text": name}))
    (tmp_path / "2011-x.txt").write_text(json.dumps({"id": 1, "text": "not compressed"}))
    found = {r.text for r in st.read_statuses(spark, str(tmp_path), pattern="2011:2012").collect()}
    assert found == {"2011-a.gz", "one/2012-b.gz"}
    with pytest.raises(ValueError):
        st.read_statuses(spark, str(tmp_path), pattern="1999")


def test_delete_messages(spark, tmp_path):
    lines = [json.dumps(STATUS), '{"delete": {"status": {"id": 10}}}', "{}", '{"other": 1}']
    (tmp_path / "m.json").write_text("\n".join(lines))
    rows = st.split_messages(st.read_raw(spark, str(tmp_path))).collect()
    assert sorted((r.id, r.op) for r in rows) == [(10, "add"), (10, "delete")]


def test_statuses_tsv(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("1\tu\tFri Mar 04 10:11:12 +0000 2011\thello\tworld\n2\tu\tno text\n3\tu\tbad date\ttext\n")
    rows = {r.id: r for r in st.read_statuses_tsv(spark, str(tmp_path)).collect()}
    assert set(rows) == {1, 3}
    assert rows[1].text == "hello world" and rows[1].epoch == 1299233472 and rows[3].epoch is None


def test_topics(spark, tmp_path):
    web = tmp_path / "web.txt"
    web.write_text('<topics>\n<topic number="52" type="x">\n  <query>two words</query>\n  <description>d</description>\n</topic>\n<topic number="51">\n<query>horse</query>\n</topic>\n</topics>\n')
    assert {(r.qid, r.query) for r in tp.read_topics(spark, str(web), "web").collect()} == {("52", "two words"), ("51", "horse")}
    tera = tmp_path / "tera.txt"
    tera.write_text("<top>\n\n<num> Number: 701 \n\n<title> U.S. oil industry history \n\n<desc> Description:\ntext\n</top>\n")
    assert tp.read_topics(spark, str(tera), "terabyte").collect()[0] == ("701", "U.S. oil industry history")
    micro = tmp_path / "micro.txt"
    one = "<top>\n<num> Number: {} </num>\n<{t}> {} </{t}>\n<querytime> x </querytime>\n<querytweettime> {} </querytweettime>\n</top>\n"
    micro.write_text(one.format("MB001", "first topic", 34952194402811904, t="title") + one.format("MB111", "other one", 5, t="query"))
    rows = tp.read_topics(spark, str(micro), "microblog")
    assert {tuple(r) for r in rows.collect()} == {("MB01", "first topic", 34952194402811904), ("MB111", "other one", 5)}
    assert {r[0] for r in rows.select(tp.run_qid("qid")).collect()} == {"1", "111"}
    micro.write_text("<top>\n<num> Number: MB001 </num>\n<title> no time </title>\n</top>\n")
    with pytest.raises(Exception, match="topic without"):
        tp.read_topics(spark, str(micro), "microblog").collect()
    with pytest.raises(ValueError):
        tp.read_topics(spark, str(micro), "other")


def test_judgments_and_lists(spark, tmp_path):
    (tmp_path / "q").write_text("1 0 d1 0\n1  Q0\td2 2\n1 0 d1 1\n2 0 d1 -1\n")
    assert {tuple(r) for r in jd.read_qrels(spark, str(tmp_path / "q")).collect()} == {("1", "d1", 1), ("1", "d2", 2), ("2", "d1", -1)}
    (tmp_path / "f").write_text("1 qid:1 1:0.5 2:3 # d1\n0 qid:1 1:0.1 2:1 # d2\n2 qid:1 1:0.7 2:4 # d1\n")
    rows = {(r.qid, r.doc_id): (r.grade, r.features) for r in jd.read_ltr(spark, str(tmp_path / "f")).collect()}
    assert rows == {("1", "d1"): (2, [0.7, 4.0]), ("1", "d2"): (0, [0.1, 1.0])}
    (tmp_path / "deletes.bz2").write_bytes(bz2.compress(b"5\tx\n6\n5\n\n"))
    assert sorted(r.id for r in jd.read_id_list(spark, str(tmp_path / "deletes.bz2")).collect()) == [5, 6]
    (tmp_path / "stop").write_text("the\n and \n\nthe\n")
    assert sorted(r.term for r in jd.read_stoplist(spark, str(tmp_path / "stop")).collect()) == ["and", "the"]
    (tmp_path / "v").write_text("2 2\ncat 0.5 1.5\ndog 1 2\n")
    assert {r.term: r.embedding for r in jd.read_vectors(spark, str(tmp_path / "v")).collect()} == {"cat": [0.5, 1.5], "dog": [1.0, 2.0]}


def test_dump_ids_fails_early(spark):
    rows = spark.createDataFrame([(1,)], "id BIGINT")
    assert fl.dump_ids(rows, "id").count() == 1
    with pytest.raises(ValueError):
        fl.dump_ids(rows, "other")
    with pytest.raises(ValueError):
        fl.dump_ids(rows.where("id > 1"), "id")
