"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .urlrules import UNWANTED


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_digest

    return mix_digest(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight,
         CAST(2 * source_size AS DOUBLE) AS bound FROM sources),
full_until AS (
  SELECT coalesce(sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (ORDER BY bound / weight DESC, source DESC NULLS FIRST) AS open_weight FROM ranked),
cutoff AS (SELECT max(((SELECT sum(source_size) FROM ranked) * CAST(1.5 AS DOUBLE) - used) / open_weight) AS t FROM full_until),
targets AS (SELECT source, source_size, least(bound, weight * t) AS target FROM ranked, cutoff),
queue AS (
  SELECT d.doc_id, d.size, s.source_size, s.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(md5('mix-1:' || d.doc_id), 1, 13), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized d JOIN targets s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)) AS BIGINT) AS taken
FROM queue
"""


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivots import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_digest

    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import spotsigs_digest

    return spotsigs_digest(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import linked

    return linked(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op6_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_runs import removal_digest

    return removal_digest(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_digest

    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import host_path, judge, named_host

    listed = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    rules = [host_path(*x) for x in listed] + [named_host(w) for w in UNWANTED]
    return judge(table(spark, sf_dir, "pages"), rules)


OP9_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules AS (
  SELECT * FROM (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
                        ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')) AS r(rule, rule_host, rule_path, verdict)),
fits AS (
  SELECT c.page_id, c.host, c.path, r.rule, r.verdict,
         row_number() OVER (PARTITION BY c.page_id, c.host, c.path ORDER BY length(r.rule) DESC, r.rule DESC) AS k
  FROM cut c JOIN rules r ON (c.host = r.rule_host OR ends_with(c.host, '.' || r.rule_host)) AND starts_with(c.path, r.rule_path))
SELECT c.page_id, c.host, c.path, f.rule,
       CASE WHEN f.rule IS NOT NULL THEN f.verdict WHEN regexp_matches(c.host, '(^|[.\-])({unwanted})[.\-]') THEN 'block' ELSE 'allow' END AS verdict
FROM cut c LEFT JOIN fits f ON c.page_id = f.page_id AND c.host = f.host AND c.path = f.path AND f.k = 1
"""

def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op1_mix": op1_mix, "op2_near_vectors": op2_near_vectors, "op3_quality": op3_quality, "op4_spotsigs": op4_spotsigs, "op5_ngram_join": op5_ngram_join, "op6_suffix_runs": op6_suffix_runs, "op7_toxicity": op7_toxicity, "op8_pack": op8_pack, "op9_url_rules": op9_url_rules, "op10_lm": op10_lm}
SQL = {"op1_mix": OP1_SQL, "op9_url_rules": OP9_SQL.replace("{unwanted}", "|".join(UNWANTED))}
