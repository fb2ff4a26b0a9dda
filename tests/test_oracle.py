"""Registered queries against their SQL. QUILLRANK_ALL=1 runs every query, else the quick ones."""

import os

import pytest

import oracle
from quillrank.plans.catalog import QUERIES, SQL

QUICK = {
    "analyze_english", "analyze_statuses", "html_to_text", "url_domain", "build_postings", "term_stats", "coll_stats", "term_dictionary",
    "prune_vectors", "normalize_l2", "interpolate_vectors", "top_df_terms", "bm25", "tfidf", "rm3_bm25", "tiebreak_recent", "with_grade",
    "mean_average_precision", "precision_at_30", "run_file", "features_pairs", "sequential_dependence", "matching_pairs", "ltr_file",
    "read_warc", "read_warc_018", "web_documents", "read_trec_web", "read_statuses", "read_topics_microblog", "read_qrels",
    "index_statuses", "city_related", "upsert", "assign_city", "city_counts", "first_per_user", "user_timelines", "class_term_freq",
    "labelled_vectors", "expand_from_timeline", "doc_embeddings", "reply_roots", "reply_chain", "ingest_with_deletes",
    "compacted_live_table", "stream_counters",
}
NAMES = [n for n in QUERIES if os.environ.get("QUILLRANK_ALL") or n in QUICK]


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf_dir, name):
    assert oracle.compare(spark, con, sf_dir, name, QUERIES[name], SQL.get(name)) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
