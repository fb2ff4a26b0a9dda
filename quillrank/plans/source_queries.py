"""Readers, checked by writing the test tables in each file format and reading them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schemas import STATUS_COLUMNS
from ..session import fresh_path
from ..sinks.files import write_lines
from ..sources import judgments as jd
from ..sources import records as rc
from ..sources import statuses as st
from ..sources import topics as tp
from ..sources.tables import read_many
from . import fixtures as fx
from .registry import query

CRLF = "\r\n"


def _warc(spark, sf, version: str, inner: str):
    """One record per page; every third record is not a response."""
    pages = fx.table(spark, sf, "pages")
    payload = F.concat(F.lit(inner), F.col("html"))
    kind = F.when(F.col("page_id") % 3 == 0, "warcinfo").otherwise("response")
    head = F.concat_ws(
        CRLF, F.lit(version), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-TREC-ID: page-"), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")), F.lit(""), F.lit(""),
    )
    path = fresh_path(spark, "warc")
    write_lines(pages.select(F.concat(head, payload, F.lit("\n")).alias("value")), path, compression="gzip")
    return path


_WARC_SQL = "SELECT 'page-' || page_id AS doc_id, url, CASE WHEN page_id % 3 = 0 THEN 'warcinfo' ELSE 'response' END AS type, {} AS content FROM pages"


@query("read_warc", _WARC_SQL.format("html"))
def read_warc(spark, sf):
    path = _warc(spark, sf, "WARC/1.0", f"HTTP/1.1 200 OK{CRLF}Content-Length: 5{CRLF}Server: x{CRLF}{CRLF}")
    return rc.read_warc(spark, path, suffix=".gz").select("doc_id", "url", "type", "content")


@query("read_warc_018", _WARC_SQL.format("E'Server: x\\r\\n\\r\\n' || html"))
def read_warc_018(spark, sf):
    path = _warc(spark, sf, "WARC/0.18", f"HTTP/1.1 200 OK{CRLF}Content-Length: 5{CRLF}Server: x{CRLF}{CRLF}")
    return rc.read_warc(spark, path, "WARC/0.18", suffix=".gz").select("doc_id", "url", "type", "content")


@query("web_documents", f"SELECT * FROM (SELECT 'page-' || page_id AS doc_id, url, {{}} AS text FROM pages WHERE page_id % 3 <> 0) WHERE length(text) > 0")
def web_documents(spark, sf):
    """Crawl files to documents: records, responses only, page text, empty pages dropped."""
    path = _warc(spark, sf, "WARC/1.0", f"HTTP/1.1 200 OK{CRLF}Content-Length: 5{CRLF}{CRLF}")
    return rc.web_documents(rc.read_warc(spark, path, suffix=".gz"))


@query(
    "read_trec_web",
    "SELECT 'GX' || page_id AS doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(html, '\\r\\n', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS content FROM pages",
)
def read_trec_web(spark, sf):
    pages = fx.table(spark, sf, "pages")
    path = fresh_path(spark, "trecweb")
    number = F.concat(F.lit("<DOC>\n<DOCNO>GX"), F.col("page_id").cast("string"), F.lit("</DOCNO>\n<DOCHDR>\n"), F.col("url"), F.lit("\n</DOCHDR>\n"))
    write_lines(pages.select(F.concat(number, F.col("html"), F.lit("\n</DOC>")).alias("value")), path, compression="gzip")
    return rc.read_trec_web(spark, path).select("doc_id", "content")


def status_lines(statuses):
    """Statuses as JSON message lines."""
    ts = F.timestamp_seconds("epoch")
    created = F.concat(F.date_format(ts, "EEE MMM d HH:mm:ss"), F.lit(" +0000 "), F.date_format(ts, "yyyy"))
    count = F.when(F.col("retweet_count") >= 100, F.lit("100+")).otherwise(F.col("retweet_count").cast("string"))
    message = F.struct(
        "id", "text", created.alias("created_at"), "lang", "in_reply_to_status_id", "in_reply_to_user_id", count.alias("retweet_count"),
        F.when(F.col("place").isNotNull(), F.struct(F.col("place").alias("full_name"))).alias("place"),
        F.when(F.col("longitude").isNotNull(), F.struct(F.array("longitude", "latitude").alias("coordinates"))).alias("coordinates"),
        F.when(
            F.col("retweeted_status_id").isNotNull(),
            F.struct(F.col("retweeted_status_id").alias("id"), F.struct(F.col("retweeted_user_id").alias("id")).alias("user")),
        ).alias("retweeted_status"),
        F.when(F.col("user_url").isNotNull(), F.struct(F.array(F.struct(F.col("user_url").alias("expanded_url"))).alias("urls"))).alias("entities"),
        F.struct(
            F.col("user_id").alias("id_str"), "screen_name", F.col("user_location").alias("location"), F.col("user_description").alias("description"),
            F.col("user_url").alias("url"), "followers_count", "friends_count", "statuses_count",
        ).alias("user"),
    )
    return statuses.select(F.to_json(message).alias("value"))


def write_statuses(spark, sf, name: str = "statuses", **writer) -> str:
    path = fresh_path(spark, name)
    write_lines(status_lines(fx.statuses(spark, sf)), path, **writer)
    return path


_READ_COLUMNS = [c for c in STATUS_COLUMNS if c not in ("created_at", "urls")]
_STATUS_SQL = fx.sql(
    "SELECT " + ", ".join(f"CASE WHEN {c} > 100 THEN 100 ELSE {c} END AS {c}" if c == "retweet_count" else c for c in _READ_COLUMNS) + ", user_url AS first_url FROM statuses", "statuses"
)


@query("read_statuses", _STATUS_SQL)
def read_statuses(spark, sf):
    found = st.read_statuses(spark, write_statuses(spark, sf, compression="gzip"))
    return found.select(*_READ_COLUMNS, F.get("urls", F.lit(0)).alias("first_url"))


@query("read_statuses_by_pattern", f"SELECT * FROM ({_STATUS_SQL}) WHERE id % 3 < 2")
def read_statuses_by_pattern(spark, sf):
    """Only files whose path holds one of the given parts are read: two of three folders."""
    path = fresh_path(spark, "statuses")
    for k, name in enumerate(("early", "later", "other")):
        write_lines(status_lines(fx.statuses(spark, sf).where(F.col("id") % 3 == k)), f"{path}/{name}", compression="gzip")
    found = st.read_statuses(spark, path, pattern="/early/:/later/")
    return found.select(*_READ_COLUMNS, F.get("urls", F.lit(0)).alias("first_url"))


@query("read_raw", fx.sql("SELECT id, text, screen_name FROM statuses", "statuses"))
def read_raw(spark, sf):
    return raw_fields(st.read_raw(spark, write_statuses(spark, sf)))


def raw_fields(lines):
    """Fields of raw lines, read by path."""
    get = lambda path: F.get_json_object("value", path)
    return lines.select(get("$.id").cast("bigint").alias("id"), get("$.text").alias("text"), get("$.user.screen_name").alias("screen_name"))


@query("read_many", fx.sql("SELECT id, count(*) AS n FROM (SELECT id FROM statuses UNION ALL SELECT id FROM statuses) GROUP BY id", "statuses"))
def read_many_collections(spark, sf):
    paths = [write_statuses(spark, sf, f"statuses-{i}") for i in range(2)]
    return read_many(spark, st.read_statuses, paths).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "read_statuses_tsv",
    fx.sql("SELECT id, screen_name, epoch, regexp_replace(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '\\t', ' ', 'g') AS text FROM statuses", "statuses"),
)
def read_statuses_tsv(spark, sf):
    rows = fx.statuses(spark, sf)
    ts = F.timestamp_seconds("epoch")
    created = F.concat(F.date_format(ts, "EEE MMM d HH:mm:ss"), F.lit(" +0000 "), F.date_format(ts, "yyyy"))
    path = fresh_path(spark, "tsv")
    write_lines(rows.select(F.concat_ws("\t", F.col("id").cast("string"), "screen_name", created, F.regexp_replace("text", r"[\r\n]+", " ")).alias("value")), path)
    return st.read_statuses_tsv(spark, path).select("id", "screen_name", "epoch", "text")


_FOLDED = "trim(regexp_replace(query, '[\\r\\n]+', ' ', 'g'))"


def _folded(df):
    return df.withColumn("query", F.trim(F.regexp_replace("query", r"[\r\n]+", " ")))


@query("read_topics_web", fx.sql(f"SELECT qid, {_FOLDED} AS query FROM topics", "topics"))
def read_topics_web(spark, sf):
    path = fresh_path(spark, "topics")
    line = F.concat(F.lit('<topic number="'), F.col("qid"), F.lit('" type="faceted">\n  <query>'), F.col("query"), F.lit("</query>\n  <description>x</description>\n</topic>"))
    write_lines(_folded(fx.topics(spark, sf)).select(line.alias("value")), path)
    return tp.read_topics(spark, path, "web")


@query("read_topics_terabyte", fx.sql(f"SELECT qid, {_FOLDED} AS query FROM topics", "topics"))
def read_topics_terabyte(spark, sf):
    path = fresh_path(spark, "topics")
    line = F.concat(F.lit("<top>\n<num> Number: "), F.col("qid"), F.lit("\n<title> "), F.col("query"), F.lit("\n\n<desc> Description:\nx\n</top>"))
    write_lines(_folded(fx.topics(spark, sf)).select(line.alias("value")), path)
    return tp.read_topics(spark, path, "terabyte")


@query("read_topics_microblog", fx.sql(f"SELECT qid, {_FOLDED} AS query, max_id FROM topics", "topics"))
def read_topics_microblog(spark, sf):
    path = fresh_path(spark, "topics")
    number = F.concat(F.lit("MB"), F.lpad("qid", 3, "0"))
    tag = F.when(F.col("max_id") % 2 == 0, F.lit("title")).otherwise(F.lit("query"))
    line = F.concat(
        F.lit("<top>\n<num> Number: "), number, F.lit(" </num>\n<"), tag, F.lit("> "), F.col("query"), F.lit(" </"), tag,
        F.lit(">\n<querytweettime> "), F.col("max_id").cast("string"), F.lit(" </querytweettime>\n</top>\n"),
    )
    write_lines(_folded(fx.timed_topics(spark, sf)).select(line.alias("value")), path)
    read = tp.read_topics(spark, path, "microblog")
    return read.select(F.when(tp.run_qid("qid") == "", "0").otherwise(tp.run_qid("qid")).alias("qid"), "query", "max_id")


@query("read_qrels", fx.sql("SELECT qid, doc_id::VARCHAR AS doc_id, grade FROM qrels", "qrels"))
def read_qrels(spark, sf):
    path = fresh_path(spark, "qrels")
    rows = fx.qrels(spark, sf)
    write_lines(rows.select(F.concat_ws(" ", "qid", F.lit("0"), F.col("doc_id").cast("string"), F.col("grade").cast("string")).alias("value")), path)
    return jd.read_qrels(spark, path)


@query("read_id_list", fx.sql("SELECT id FROM deletes", "deletes"))
def read_id_list(spark, sf):
    path = fresh_path(spark, "deletes")
    write_lines(fx.deletes(spark, sf).select(F.concat(F.col("id").cast("string"), F.lit("\tgone")).alias("value")), path, compression="bzip2")
    return jd.read_id_list(spark, path)


@query("read_cohort", fx.sql("SELECT user_id FROM cohort", "cohort"))
def read_cohort(spark, sf):
    path = fresh_path(spark, "cohort")
    write_lines(fx.cohort(spark, sf).select(F.col("user_id").alias("value")), path)
    return jd.read_cohort(spark, path)


@query("read_vectors", f"SELECT 't' || vec_id AS term, len(embedding)::INT AS n, {fx.WEIGHTED_SQL} AS weighted FROM embeddings")
def read_vectors(spark, sf):
    rows = fx.table(spark, sf, "embeddings")
    path = fresh_path(spark, "vectors")
    values = F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")
    write_lines(rows.select(F.concat(F.lit("t"), F.col("vec_id").cast("string"), F.lit(" "), values).alias("value")), path)
    read = jd.read_vectors(spark, path)
    return read.select("term", F.size("embedding").alias("n"), fx.weighted("embedding").alias("weighted"))


def _fill_web_sql() -> None:
    from .index_queries import _html_sql
    from .registry import SQL

    SQL["web_documents"] = SQL["web_documents"].replace("{}", _html_sql("html"))


_fill_web_sql()
