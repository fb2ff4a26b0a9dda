"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quillrank.functions import text as tx  # noqa: E402
from quillrank.operators import evaluate as ev  # noqa: E402
from quillrank.operators import features as ft  # noqa: E402
from quillrank.operators import feedback as fb  # noqa: E402
from quillrank.operators import geo  # noqa: E402
from quillrank.operators import joins as jn  # noqa: E402
from quillrank.operators import postings as po  # noqa: E402
from quillrank.operators import ranking as rk  # noqa: E402
from quillrank.operators import rerank as rr  # noqa: E402
from quillrank.plans import fixtures as fx  # noqa: E402
from quillrank.session import fresh_path, local_session, spread  # noqa: E402
from quillrank.streaming import live  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    work = tempfile.mkdtemp(prefix="bench-")
    spark = local_session(CPUS, "bench", **{"spark__checkpoint__dir": work})
    corpus, topics, qrels = fx.corpus(spark, SF_DIR), fx.topics(spark, SF_DIR), fx.qrels(spark, SF_DIR)
    path = f"{work}/index"
    seconds: dict[str, float] = {}
    wanted = sys.argv[1:]

    def timed(name, job) -> None:
        if wanted and name != "index_build" and name not in wanted:
            return
        start = time.time()
        job()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)

    run(corpus)  # session start-up is not part of any job
    timed("index_build", lambda: po.write_index(corpus, path, buckets=16))
    index = po.read_index(spark, path)
    stop = rk.top_df_terms(index.terms)
    timed("bm25", lambda: run(rk.bm25(index, topics)))
    timed("query_likelihood", lambda: run(rk.query_likelihood(index, topics)))
    timed("tfidf", lambda: run(rk.tfidf(index, topics)))
    timed("search_one_query", lambda: rk.search(index, "and the of with", 20).collect())
    timed("rm3_bm25", lambda: run(fb.rm3(index, topics, rk.bm25(index, topics), rk.bm25_model(index, 0.9, 0.4), stop)))
    timed("features_judged_20", lambda: run(ft.extract_judged(qrels, index, topics)))
    timed("sdm_judged", lambda: run(ft.extract_judged(qrels, index, topics, ["SDM"])))
    timed("tiebreak", lambda: run(rr.tiebreak_recent(rk.bm25(index, topics), fx.statuses(spark, SF_DIR).select(F.col("id").alias("doc_id"), "retweeted_status_id"))))
    timed("map", lambda: ev.mean_average_precision(rk.bm25(index, topics), qrels).collect())
    timed("html_to_text", lambda: run(spread(fx.table(spark, SF_DIR, "pages")).select(tx.html_to_text("html"))))
    timed("status_tokens", lambda: run(po.analyze(spread(corpus), analyzer=tx.status_tokens)))
    timed("stem_postings", lambda: run(po.stem_postings(index.postings)))
    timed("city_counts", lambda: run(geo.city_counts(fx.statuses(spark, SF_DIR), fx.cities(spark, SF_DIR))))
    timed("user_timelines", lambda: run(geo.user_timelines(fx.timelines(spark, SF_DIR))))
    timed("doc_embeddings", lambda: run(geo.doc_embeddings(index.postings, fx.ranked_vectors(spark, SF_DIR, index.terms), 64)))
    timed("term_dictionary", lambda: run(po.term_dictionary(index.postings)))
    timed("reply_roots", lambda: run(jn.reply_roots(fx.replies(spark, SF_DIR))))

    def stream() -> None:
        schema = fx.table(spark, SF_DIR, "events").schema
        events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF_DIR)
        live.ingest(fx.messages(events), f"{work}/live", fresh_path(spark, "cp"), order="seq").awaitTermination()
        run(live.live_table(spark, f"{work}/live"))

    timed("ingest_with_deletes", stream)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_time_of_headline_jobs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cores": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
