"""Registered corpus queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoseries.llm import byte_bpe, decontamination, exact_dedup, filter_audit, html_text, language, near_dedup, neighbours, quality, spelling, token_files, toxicity, warc
from geoseries.llm.common import learnable, small_batches, table
from geoseries.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return build


@query
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = token_files.write_token_files(docs, uri, path, public_tokenizers.PATTERN, end_id=2, parts=parts, added=True)
    return token_files.read_documents(spark, uri, files)


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = table(spark, sf_dir, "documents"), learnable("doc_id", 3, 1)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn)
    found = toxicity.severity(docs, model)
    return found.select("doc_id", (~learn).alias("held_out"), "severity", "grade", "score", "predicted")


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch_path(spark, "warc")
    warc.archive_pages(table(spark, sf_dir, "pages"), uri)
    return warc.page_records(spark, uri)


# Base32: eight groups of five hexadecimal digits, four characters each.
ORACLE["op4_warc"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages)
SELECT page_id, octet_length(body) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p
"""


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = decontamination.flag_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest_columns(flagged)


ORACLE["op6_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS size, w[i:i + least(len(w), 10) - 1] AS win
       FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT r, i, size, w[i:i + size - 1] AS win
       FROM d, (SELECT DISTINCT size FROM bw), unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size),
m AS (SELECT r, i, size, item FROM dw JOIN bw USING (size, win)),
h AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM m, unnest(range(size)) AS t(k) GROUP BY r),
s AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)
"""


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = table(spark, sf_dir, "documents"), learnable("doc_id", 3, 1)
    model = quality.train(docs, table(spark, sf_dir, "labels"), learn)
    return quality.score(docs, model).select("doc_id", (~learn).alias("held_out"), "score", "predicted")


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(table(spark, sf_dir, "documents"))


ORACLE["op8_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = learnable("doc_id", 5, 0)
    samples = language.draw_samples(language.learned_rows(docs, held=~learn))
    return language.identify(docs, samples).select("doc_id", (~learn).alias("held_out"), "lang_pred", "score")


@query
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), size=3, percent=85)


@query
def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op11_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT doc_id, part,
         CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
         + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT)
         + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
         + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INT) AS failed
  FROM d),
c AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, failed),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a JOIN x b ON b.x <> a.x JOIN x c ON c.x NOT IN (a.x, b.x) JOIN x d ON d.x NOT IN (a.x, b.x, c.x)
       JOIN x e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM o, unnest(range(1, 6)) AS t(step)),
r AS (
  SELECT part, filter_order, step, own,
         sum(n) FILTER (WHERE failed & (earlier | own) = 0) AS kept,
         sum(n) FILTER (WHERE failed & own <> 0 AND failed & earlier = 0) AS removed,
         sum(n) FILTER (WHERE failed & own <> 0 AND failed & earlier <> 0) AS redundant,
         sum(n) FILTER (WHERE failed = own) AS unique_fails,
         sum(good) FILTER (WHERE failed & own <> 0 AND failed & earlier = 0) AS good_lost,
         sum(toxic) FILTER (WHERE failed & own <> 0 AND failed & earlier = 0) AS toxic_lost
  FROM c CROSS JOIN s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
