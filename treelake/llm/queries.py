"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.llm import bpe, fingerprint, hmm, jaccard, langid, mixing, secrets, telephony, toxicity, url_filter
from treelake.llm._spark import table

URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.Rule.parse(*r) for r in URL_RULES]
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


OP1_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM cut
), rules(rule, rhost, rpath, verdict, labels) AS (
  VALUES ('com/en/', 'com', '/en/', 'block', 1), ('example.com/en/7', 'example.com', '/en/7', 'allow', 2),
         ('net/de/', 'net', '/de/', 'allow', 1), ('example.net/de/8', 'example.net', '/de/8', 'block', 2), ('org/es/', 'org', '/es/', 'block', 1)
), fits AS (
  SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY labels DESC, length(rpath) DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND k = 1
"""


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 9))


OP4_SQL = r"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens, md5(coalesce(text, '')) AS m FROM documents
), sources AS MATERIALIZED (
  SELECT source, sum(tokens)::BIGINT AS total FROM docs GROUP BY source HAVING sum(tokens) > 0
), shares AS MATERIALIZED (
  SELECT source, total, total / (SELECT sum(total)::DOUBLE FROM sources) AS p, (SELECT count(*) FROM sources) AS n, (SELECT min(total) / sum(total)::DOUBLE FROM sources) AS least FROM sources
), flat(k, low, high, mid) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END, (CASE WHEN ok THEN mid ELSE low END + CASE WHEN ok THEN high ELSE mid END) / 2
  FROM (SELECT k, any_value(low) AS low, any_value(high) AS high, any_value(mid) AS mid, ln(sum(p ** mid)) - any_value(mid) * sum(p ** mid * ln(p)) / sum(p ** mid) >= 0.98 * ln(any_value(n)) - 1e-12 AS ok FROM flat, shares GROUP BY k)
  WHERE k < 40
), often(k, low, high, mid) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END, (CASE WHEN ok THEN mid ELSE low END + CASE WHEN ok THEN high ELSE mid END) / 2
  FROM (SELECT k, any_value(low) AS low, any_value(high) AS high, any_value(mid) AS mid, any_value(least) ** (any_value(mid) - 1) / sum(p ** mid) > 4.0 AS ok FROM often, shares GROUP BY k)
  WHERE k < 40
), exponent AS (
  SELECT CASE WHEN (SELECT count(*) FROM sources) < 2 THEN 1.0 ELSE round(greatest((SELECT low FROM flat WHERE k = 40), (SELECT low FROM often WHERE k = 40)), 6) END AS a
), weights AS (
  SELECT source, total, p ** a / (SELECT sum(p ** a) FROM shares, exponent) AS weight FROM shares, exponent
), quotas AS (
  SELECT source, total, weight, floor(round(weight * (SELECT sum(total)::DOUBLE FROM sources), 3))::BIGINT AS quota FROM weights
), laid AS (
  SELECT d.doc_id, d.source, d.tokens, d.m, weight, quota // total AS whole, quota % total AS rest, pass,
         md5(concat_ws('|', '20', pass, d.doc_id, d.m)) AS "order"
  FROM docs d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source, unnest(range(quota // total + 1)) t(pass)
), summed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source, pass ORDER BY "order", doc_id, m ROWS UNBOUNDED PRECEDING) AS until FROM laid
)
SELECT doc_id, source, tokens, round(weight, 9) AS weight, pass::INT AS pass, "order" FROM summed WHERE pass < whole OR (until <= rest AND rest > 0)
"""


def remainder(k: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo k; -1 for a null id, so that it is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % k, F.lit(-1))


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), remainder(7) == 2)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digests(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda i: F.crc32(i.cast("string").cast("binary")) % 4 != 2)
    return toxicity.score(docs, machine, remainder(4) == 2)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), remainder(4) == 2)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op9_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_counts(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS MATERIALIZED (
  SELECT d.doc_id, count(s) AS n FROM documents d LEFT JOIN shingles s ON s.doc_id = d.doc_id GROUP BY d.doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT x AS doc_id, n AS n_shingles, min(y) AS component_id FROM reach JOIN sizes ON sizes.doc_id = x GROUP BY x, n
"""


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op4_mixing": OP4_SQL, "op9_jaccard": OP9_SQL}
