"""The registered queries of this subpackage, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate, exact_dedup, forest, language_model, mining, packing, pages, quality, ranked, simhash, substrings, urls, warc,
)
from tidemark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    """Register a query under the name of its function."""
    QUERIES[function.__name__] = function
    return function


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.cut_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.repeats(table(spark, sf_dir, "documents"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record derived from `pages`, with what it stands for."""
    found = warc.resolve(warc.records_of(table(spark, sf_dir, "pages")))
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select(
        "record_id", "kind", F.col("key").alias("url_key"), "status", "response_id", F.array_join(pairs, ";").alias("headers"),
        F.sha2("payload", 256).alias("payload_sha256"),
    )


@query
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near-duplicates."""
    return forest.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three negatives for each of up to five positives of every anchor."""
    return mining.hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLES["op3_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), item AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS t
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM item)
), sizes AS (SELECT DISTINCT n FROM win),
doc AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes)
), hit AS (SELECT doc_id, item_id, doc.s, doc.n FROM doc JOIN win USING (n, t)),
cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES["op4_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ORACLES["op6_url_filter"] = r"""
WITH u AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(name, start, says) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fit AS (
  SELECT page_id, arg_max(name || start, length(name || start)) AS rule, arg_max(says, length(name || start)) AS says
  FROM u JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id
), form AS (
  SELECT u.*, rule, says, host || regexp_replace(path, '(\.html?|/)$', '') || coalesce('?' || nullif(array_to_string(list_filter(
    string_split(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_\w+|ref)=')), '&'), ''), '') AS f
  FROM u LEFT JOIN fit USING (page_id)
), told AS (SELECT f, bool_or(says = 'allow') AS allowed FROM form WHERE says IS NOT NULL GROUP BY f)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN NOT allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM form LEFT JOIN told ON form.f = told.f AND contains(url, '://')
"""

ORACLES["op7_warc_revisits"] = r"""
WITH p AS (
  SELECT page_id AS n, coalesce(html, '') AS body, html, substr(md5(coalesce(html, '')), 1, 12) AS etag,
    lower(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')) || regexp_replace(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '(\.html?|/)$', '') AS k
  FROM pages
), r AS (SELECT 2 * n AS id, 60 * n AS t, k, etag, body, html, n FROM p WHERE n % 11 <> 3),
v AS (
  SELECT 2 * n + 1 AS id, 60 * n + 40 + 30 * (n % 4) AS t, k,
    CASE WHEN n % 7 = 2 THEN 'changed' WHEN n % 5 <> 1 THEN etag END AS etag FROM p
), j AS (
  SELECT v.*, r.id AS rid, r.etag AS retag, r.html AS rhtml, length(r.body) AS size,
    CASE WHEN r.id IS NULL THEN 'missing' WHEN v.etag IS NULL OR v.etag = r.etag THEN 'resolved' ELSE 'stale' END AS status
  FROM v ASOF LEFT JOIN r ON v.k = r.k AND v.t > r.t
)
SELECT id AS record_id, 'response' AS kind, k AS url_key, 'full' AS status, id AS response_id,
  'content-length=' || length(body) || ';date=' || t || ';etag=' || etag AS headers, sha256(html) AS payload_sha256
FROM r UNION ALL
SELECT id, 'revisit', k, status, rid,
  CASE WHEN status = 'resolved' THEN 'content-length=' || size || ';date=' || t || ';etag=' || retag || ';expires=' || (t + 600)
    ELSE 'content-length=0;date=' || t || ';expires=' || (t + 600) END,
  CASE WHEN status = 'resolved' THEN sha256(rhtml) END
FROM j
"""

ORACLES["op11_ranked_search"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, unnest(list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS t
  FROM benchmark
), q AS (SELECT item_id, t, count(*) AS times FROM b GROUP BY ALL),
total AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d),
tf AS (
  SELECT doc_id, n, t, count(*) AS tf
  FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL
), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM df, total),
hit AS (
  SELECT doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))) AS part
  FROM tf JOIN weights USING (t), total
), scored AS (SELECT item_id, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM q JOIN hit USING (t) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 20
"""

ORACLES["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.e, r.e) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 3
"""
