"""Streams restarted from their checkpoint, late deletes, commit intervals."""

import json
import os

from quillrank import versions
from quillrank.operators import segments
from quillrank.plans import fixtures as fx
from quillrank.sources import statuses as st
from quillrank.streaming import counters as ct
from quillrank.streaming import live


def put(folder, name, *messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(m) for m in messages))


def status(i, text="hello"):
    return {"id": i, "text": text, "user": {"id_str": str(i % 2), "statuses_count": i}, "place": {"full_name": "Pittsburgh, PA"}}


def gone(i):
    return {"delete": {"status": {"id": i}}}


def test_ingest_restart_and_compaction(spark, tmp_path):
    source, path, cp = tmp_path / "in", str(tmp_path / "live"), str(tmp_path / "cp")

    def drain():
        live.ingest(st.split_messages(st.stream_messages(spark, str(source), 1)), path, cp).awaitTermination()
        return {r.id: r.text for r in live.live_table(spark, path).collect()}

    put(source, "a.json", gone(3), status(1), status(2), status(1, "again"), gone(2))
    assert drain() == {1: "again"}
    put(source, "b.json", status(3), status(2, "back"), gone(1))
    assert drain() == {2: "back", 3: "hello"}
    assert drain() == {2: "back", 3: "hello"}
    live.compact_live(spark, path)
    put(source, "c.json", gone(2), status(4))
    assert drain() == {3: "hello", 4: "hello"}
    found = live.live_search(spark, path, "hello", 5).collect()
    assert [r.doc_id for r in found] == [3, 4]


def test_an_index_follows_the_stream_over_restarts(spark, tmp_path):
    source, path, cp = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "cp")
    segments.create(spark, path, positions=False, term_buckets=4, doc_buckets=4)

    def drain(checkpoint=cp):
        live.index_stream(st.split_messages(st.stream_messages(spark, str(source), 1)), path, checkpoint).awaitTermination()
        return [r.doc_id for r in live.live_search(spark, path, "hello", 5).collect()]

    put(source, "a.json", gone(3), status(1), status(2), status(1, "again"), gone(2), status(5))
    assert drain() == [5]
    before = versions.newest(spark, path)
    put(source, "b.json", status(3), status(2, "back"), gone(5))
    assert drain() == [3]
    assert drain() == [3] and versions.newest(spark, path).number > before.number
    again = versions.newest(spark, path)
    assert drain(str(tmp_path / "lost")) == [3]  # batches that the index has count once, whoever brings them
    assert versions.newest(spark, path) == again
    assert sorted(r.doc_id for r in segments.read_segments(spark, path).lengths.collect()) == [1, 2, 3]


def test_deletes_in_a_later_file_of_the_same_batch(spark, tmp_path):
    """Files of a batch are split by size, so the larger file is read first; what counts is when they were written."""
    source, path = tmp_path / "in", str(tmp_path / "live")
    put(source, "a.json", status(1), status(2))
    put(source, "b.json", gone(1), *[status(i, "long text " * 50) for i in range(10, 60)])
    put(source, "c.json", status(3), gone(2), gone(10))
    for i, name in enumerate(("a.json", "b.json", "c.json")):
        os.utime(source / name, (1_700_000_000 + i, 1_700_000_000 + i))
    live.ingest(st.split_messages(st.stream_messages(spark, str(source), 100)), path, str(tmp_path / "cp")).awaitTermination()
    assert {r.id for r in live.live_table(spark, path).collect()} == {3, *range(11, 60)}


def test_counters_after_restart_equal_the_batch(spark, tmp_path, sf_dir):
    source, cp = tmp_path / "in", str(tmp_path / "cp")
    cities = fx.cities(spark, sf_dir)

    def drain():
        stream = st.split_messages(st.stream_messages(spark, str(source), 1)).where("op = 'add'")
        ct.stream_counters(stream, cities, str(tmp_path / "out"), cp).awaitTermination()
        batch = ct.count_statuses(st.split_messages(st.read_raw(spark, str(source))).where("op = 'add'"), cities)
        got = spark.read.parquet(str(tmp_path / "out")).first()
        assert got == batch.first()
        return got

    put(source, "a.json", status(1), {**status(2), "coordinates": {"coordinates": [0.05, 0.1]}})
    assert drain().n_geo == 1
    put(source, "b.json", status(3))
    assert drain().n_indexed == 3


def test_user_frequency_is_updated(spark, tmp_path):
    source, cp, out = tmp_path / "in", str(tmp_path / "cp"), str(tmp_path / "out")

    def drain():
        stream = st.split_messages(st.stream_messages(spark, str(source), 1)).where("op = 'add'")
        where = {"name": "Pittsburgh, PA", "short_name": "Pittsburgh", "lon": -79.97, "lat": 40.44}
        ct.stream_user_frequency(stream, out, cp, **where).awaitTermination()
        return {r.user_id: (r.statuses_count, r.n_posts) for r in ct.user_frequency(spark, out).collect()}

    put(source, "a.json", status(1), status(2), status(3))
    assert drain() == {"1": (3, 2), "0": (2, 1)}
    put(source, "b.json", status(4), {**status(6), "place": None})
    assert drain() == {"1": (3, 2), "0": (4, 2)}


def test_commit_interval_is_a_trigger(spark, tmp_path):
    source = tmp_path / "in"
    put(source, "a.json", status(1))
    stream = st.split_messages(st.stream_messages(spark, str(source)))
    query = live.ingest(stream, str(tmp_path / "live"), str(tmp_path / "cp"), processingTime="1 second")
    try:
        query.processAllAvailable()
        assert live.live_table(spark, str(tmp_path / "live")).count() == 1
    finally:
        query.stop()


def test_raw_archive(spark, tmp_path):
    source = tmp_path / "in"
    put(source, "a.json", status(1), gone(1))
    live.archive_raw(st.stream_messages(spark, str(source)), str(tmp_path / "raw"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.text(str(tmp_path / "raw")).count() == 2
