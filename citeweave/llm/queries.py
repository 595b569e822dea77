"""The operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm import bpe, conversations, exact, minhash, mixing, packing, quality, secrets, sharding, spelling, tiff, toxicity, urls
from citeweave.llm.common import materialize

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _held(modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves the rest; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = _tokenizer("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), path, pattern, with_ids=False)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    machine = toxicity.learn(docs, _read(spark, sf_dir, "labels"), ~_held(3, 1))
    return toxicity.score_documents(docs, machine).select("doc_id", _held(3, 1).alias("held_out"), "score", "predicted")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json")[0])


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"), RULES)


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.store_texts(_read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(quality.document_statistics(_read(spark, sf_dir, "documents")), "statistics")
    model = quality.learn(stats, _read(spark, sf_dir, "labels"), ~_held(5, 0))
    return quality.score_statistics(stats, model).select("doc_id", _held(5, 0).alias("held_out"), "score", "predicted")


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_read(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(_read(spark, sf_dir, "conversations"))


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe, op2_shards, op3_minhash, op4_toxicity, op5_secrets, op6_packing, op7_urls, op8_tiff, op9_quality, op10_exact, op11_repair, op12_mix, op13_spelling)
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op7_urls": f"""
WITH parts AS (
  SELECT page_id, {_LOW.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM parts),
outcomes AS (
  SELECT *, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS bad FROM ruled),
hosts AS (
  SELECT host, CASE WHEN address THEN site WHEN two IN {urls.SUFFIXES} THEN array_to_string(labels[-3:], '.') ELSE two END AS domain,
    CASE WHEN address THEN 'ip' WHEN two IN {urls.SUFFIXES} THEN two ELSE labels[-1] END AS suffix, n, bad
  FROM (SELECT *, string_split(site, '.') AS labels, array_to_string(string_split(site, '.')[-2:], '.') AS two, regexp_full_match(site, '[0-9]+([.][0-9]+){{3}}') AS address
    FROM (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), '[.]?(:[0-9]*)?$', '') AS site, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM outcomes GROUP BY host))),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
levels AS (
  SELECT 0 AS level, n, bad FROM suffixes UNION ALL SELECT 1, n, bad FROM domains UNION ALL SELECT 2, n, bad FROM hosts),
sums AS (
  SELECT level, sum(n)::DOUBLE AS n, sum(bad) / sum(n)::DOUBLE AS mean, count(*) AS units, sum(bad * bad / n::DOUBLE) AS spread FROM levels WHERE n > 0 GROUP BY level),
moments AS (
  SELECT level, mean, spread / n - mean * mean - mean * (1 - mean) * (units - 1) / n AS between_ FROM sums),
priors AS (
  SELECT level, mean, CASE WHEN between_ <= 0 THEN 1000.0 ELSE greatest(1.0, least(1000.0, mean * (1 - mean) / between_ - 1)) END AS k FROM moments),
k AS (
  SELECT coalesce(max(mean) FILTER (level = 0), 0) AS whole, coalesce(max(k) FILTER (level = 0), 1) AS k0, coalesce(max(k) FILTER (level = 1), 1) AS k1,
    coalesce(max(k) FILTER (level = 2), 1) AS k2 FROM priors),
s AS (SELECT suffix, (bad + k0 * whole) / (n + k0) AS rate FROM suffixes, k),
d AS (SELECT domain, (domains.bad + k1 * s.rate) / (domains.n + k1) AS rate FROM domains JOIN s USING (suffix), k),
h AS (SELECT host, (hosts.bad + k2 * d.rate) / (hosts.n + k2) AS rate, hosts.n + k2 AS weight FROM hosts JOIN d USING (domain), k),
b AS (SELECT host, rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) > 0.5 AS blocked FROM h)
SELECT page_id, host, path, rule, CASE WHEN bad = 1 THEN 'block' WHEN bad = 0 THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM outcomes JOIN b USING (host)""",
    "op10_exact": f"""
WITH t AS (SELECT doc_id, {_LOW.format("coalesce(text, '')")} AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)""",
    "op3_minhash": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(first_, doc_id)) AS component_id, doc_id <= coalesce(first_, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS first_ FROM reach GROUP BY doc_id) USING (doc_id)""",
}
