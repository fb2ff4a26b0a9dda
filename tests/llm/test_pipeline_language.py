"""The language that the first stage of the pipeline finds is what the others and the result have."""

import corpus_pipeline

from helpers import documents


def test_the_found_language_reaches_the_result(spark, tmp_path):
    english, french = "the of and is in that ", "le la les des une est dans "
    rows = [(i, (french if i % 2 else english) * 5 + f"w{i}", "fr-FR" if i % 2 else "EN", "a") for i in range(60)]
    rows += [(100, english * 9, None, "a"), (101, french * 9, "en", "a"), (102, "12", "en", "a"), (103, None, "en", "a")]
    documents(spark, rows, False).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()}
    assert found == {i: "fr" if i % 2 else "en" for i in range(60)} | {100: "en", 101: "fr"}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.lang == found[r.doc_id] and r.source == "a" for r in out)
