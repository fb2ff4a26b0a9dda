"""Queries of the dealt operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..functions.text import html_to_text
from . import bpe, chunk_bpe, html_extract, language_id, licenses, mixing, pii
from .conversation_trie import conversation_trie
from .ego_join import embedding_duplicates
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .hyperminhash import near_duplicates
from .registry import QUERIES, SQL, query, table
from .substring_dedup import substring_dedup


@query("op1_substring_dedup")
def op1(spark, sf_dir):
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_mixing_to_target_weights")
def op2(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"), unknown=True).drop("key")


@query("language_id_of_pages")
def language_id_of_pages(spark, sf_dir):
    """The same over web pages: text without markup, declared language, top-level domain and host."""
    pages = table(spark, sf_dir, "pages")
    host = F.parse_url("url", F.lit("HOST"))
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z-]+)", 1)
    found = language_id.identify(pages, "page_id", html_to_text(F.col("html")), declared, host, F.regexp_extract(host, r"[^.]+$", 0), unknown=True)
    return found.drop("key").withColumnRenamed("doc_id", "page_id")


@query("op4_byte_level_bpe")
def op4(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_license_scans", licenses.scan_sql("documents"))
def op5(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op6_minhash_near_dedup")
def op6(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_pii")
def op7(spark, sf_dir):
    return pii.span_digests(table(spark, sf_dir, "documents"))


@query("op8_html_extraction")
def op8(spark, sf_dir):
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query(
    "op9_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
              doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
       FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op9(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op10_embedding_near_dedup")
def op10(spark, sf_dir):
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


_SHIFTED = "CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END"


@query(
    "op11_hard_negatives",
    f"""WITH v AS (SELECT vec_id, {_SHIFTED} AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
      FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a JOIN v r ON a.vec_id <> r.vec_id),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id, row_number() OVER best AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER best <= 5""",
)
def op11(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query("op12_chunked_bpe")
def op12(spark, sf_dir):
    return chunk_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_CRC32 = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, (u & 1) * 3988292384::UBIGINT))))"""


@query(
    "op13_conversation_trie",
    f"""WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS pos, digest, chars
      FROM (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
        length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL)),
    convs AS (SELECT *, least(h, coalesce((SELECT count(*) FROM own WHERE own.conv_id = donor), 0)) AS given
      FROM (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS donor, ({_CRC32} % 6)::BIGINT AS h FROM own)),
    turns AS (SELECT c.conv_id, o.pos, digest, chars FROM convs c JOIN own o ON o.conv_id = c.donor AND o.pos <= h
      UNION ALL SELECT conv_id, pos - h + given, digest, chars FROM convs JOIN own USING (conv_id) WHERE pos > h),
    prefixes AS (SELECT conv_id, pos AS depth, chars, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM turns),
    nodes AS (SELECT path, depth, any_value(chars) AS chars, count(*) AS n_convs, min(conv_id) AS conv_id FROM prefixes GROUP BY path, depth
      UNION ALL SELECT '', 0, 0, count(*), min(conv_id) FROM convs HAVING count(*) > 0),
    kids AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
    under AS (SELECT left(path, 64 * d) AS path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
      FROM (SELECT n.path, unnest(range(depth + 1)) AS d, (k.n IS NULL)::BIGINT AS leaf, (n_convs - 1) * chars AS saved FROM nodes n LEFT JOIN kids k USING (path)) GROUP BY 1),
    ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
      FROM (SELECT c.conv_id, coalesce(max_by(path, depth), '') AS path FROM convs c LEFT JOIN prefixes p ON p.conv_id = c.conv_id GROUP BY c.conv_id) GROUP BY 1)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM nodes n JOIN under u ON u.path = n.path LEFT JOIN kids k ON k.path = n.path LEFT JOIN ends e ON e.path = n.path
      LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 64 * (n.depth - 1))""",
)
def op13(spark, sf_dir):
    conv = F.col("conv_id")
    return conversation_trie(table(spark, sf_dir, "conversations"), F.crc32(conv.cast("string")) % 6, conv - conv % 100)


__all__ = ["QUERIES", "SQL"]
