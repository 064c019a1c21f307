"""The registered queries opN_<name>: thin digests of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fm_index, langid, mixture, ngram_join, ogg, pii, secrets_crf, suffix_dedup, toxicity, warc
from .common import table


def fold_of(divisor: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, lexicon).select("doc_id", F.coalesce(fold_of(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("matches").alias("n_matches"))


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


def op4_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.ogg_digests(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(langid.learnable(docs)))
    return found.select("doc_id", F.coalesce(fold_of(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("spans")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.size(F.filter("spans", (lambda kind: lambda x: x["base"] & (x["kind"] == kind))(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets_crf.find_secrets(docs, secrets_crf.fit(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_records(warc.captures(table(spark, sf_dir, "pages")))
    entries = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return warc.resolve(records).select("record_id", "canonical_url", "seconds", "status", "refers_to", "body_sha256", "body_bytes", F.md5(entries).alias("headers_md5"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_toxicity, op3_mixture, op4_ogg, op5_langid, op6_suffix_dedup, op7_pii, op8_decontamination, op9_secrets, op10_warc)}
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s FROM words),
parts AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM parts a JOIN parts b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS x, a AS y FROM ways UNION SELECT r.x, e.b FROM reach r JOIN ways e ON r.y = e.a),
least_of AS (SELECT x, min(y) AS component FROM reach GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.component, s.doc_id) AS component_id FROM sets s LEFT JOIN least_of l ON l.x = s.doc_id
"""

OP6_SQL = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
places AS (SELECT doc_id, unnest(range(0, (len(x) // 2 - 99)::BIGINT)) AS s FROM t),
strings AS (SELECT p.doc_id, p.s, md5_number(substr(t.x, 2 * p.s + 1, 200)) AS h FROM places p JOIN t USING (doc_id)),
later AS (SELECT doc_id, s FROM strings QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
fresh AS (SELECT doc_id, s, s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, -1) AS new FROM later),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM (SELECT doc_id, s, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM fresh) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b, b - a AS n FROM runs
  UNION ALL SELECT doc_id, coalesce(max(b), 0), NULL, NULL FROM t LEFT JOIN runs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (any_value(len(x)) // 2)::BIGINT AS n_bytes, coalesce(sum(n), 0)::BIGINT AS n_removed, count(n)::BIGINT AS n_spans,
  sha256(unhex(string_agg(substr(x, 2 * a + 1, 2 * coalesce(b - a, len(x))), '' ORDER BY a, b NULLS LAST))) AS kept_sha256
FROM t JOIN gaps USING (doc_id) GROUP BY doc_id
"""

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM
  (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT p.doc_id, p.k, p.n, v.item_id FROM places p JOIN windows v ON p.n = v.n AND p.t = v.t),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_REST = r"regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
_HOST = rf"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({_REST}, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '')"
_QUERY = rf"array_to_string(list_sort(list_filter(string_split(regexp_extract({_REST}, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))), '&')"

OP10_SQL = rf"""
WITH p AS (SELECT page_id AS k, html, url LIKE '%?%' AS dated, strlen(html) AS n, md5(html) AS m, greatest(0, page_id + ('0x' || substr(md5(url), 1, 4))::BIGINT - 16384) AS again,
  {_HOST} || regexp_replace(regexp_extract({_REST}, '^[^/?]*([^?]*)', 1), '/+$', '') || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END AS c FROM pages),
v AS (SELECT a.k, a.c, a.again, a.dated, a.m, max_by(b.k, b.k) AS r FROM p a LEFT JOIN p b ON a.c = b.c AND b.k < a.again GROUP BY ALL),
j AS (SELECT v.*, b.n, b.html, CASE WHEN v.r IS NULL THEN 'unresolved' WHEN v.dated AND b.dated AND v.k = b.k OR NOT v.dated AND NOT b.dated AND v.m = b.m THEN 'resolved' ELSE 'mismatch' END AS status FROM v LEFT JOIN p b ON v.r = b.k)
SELECT 'r:' || k AS record_id, c AS canonical_url, k AS seconds, 'full' AS status, NULL::VARCHAR AS refers_to, sha256(html) AS body_sha256, n::BIGINT AS body_bytes,
  md5('cache-control=max-age=60;content-length=' || n || ';content-type=text/html;' || CASE WHEN dated THEN 'last-modified=v' || k ELSE 'etag="' || m || '"' END) AS headers_md5 FROM p
UNION ALL
SELECT 'v:' || k, c, again, status, 'r:' || r, CASE WHEN status = 'resolved' THEN sha256(html) END, CASE WHEN status = 'resolved' THEN n END::BIGINT,
  md5('cache-control=max-age=' || k % 7 || ';content-length=' || CASE WHEN status = 'resolved' THEN n || ';content-type=text/html' ELSE '0' END || ';' || CASE WHEN dated THEN 'last-modified=v' || k ELSE 'etag=W/"' || m || '"' END) FROM j
"""

ORACLES = {"op1_ngram_join": OP1_SQL, "op6_suffix_dedup": OP6_SQL, "op8_decontamination": OP8_SQL, "op10_warc": OP10_SQL}
