"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treelake.sources.catalog import EPOCH_MS, NOW_MS, Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions of the catalog, in DuckDB's dialect.
CTES = {
    "regular": """
  SELECT '/docs/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, doc_id AS k, text AS content FROM documents
  UNION ALL SELECT '/web/' || page_id || '.html', page_id, html FROM pages
  UNION ALL SELECT '/chat/' || conv_id || '/' || CASE WHEN turn = 0 THEN '.' ELSE '' END || turn || '-' || role || '.md', conv_id * 100 + turn, text FROM conversations""",
    "files": f"""
  SELECT CASE WHEN path = '/' THEN 0 ELSE ('0x' || substr(md5(path), 1, 15))::BIGINT END AS id, path,
         CASE WHEN path = '/' THEN '/' ELSE string_split(path, '/')[-1] END AS name,
         CASE WHEN path = '/' THEN NULL WHEN len(string_split(path, '/')) = 2 THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent,
         CASE WHEN path = '/' THEN 0 ELSE len(string_split(path, '/')) - 1 END AS depth,
         type, mode, uid, gid, size, blob_id, tier, mtime, atime
  FROM (
    SELECT path, 'file' AS type, [420, 384, 493][k % 3 + 1] AS mode, (k % 5)::INT AS uid, (k % 3)::INT AS gid, strlen(content) AS size, 'blob-' || sha256(content) AS blob_id,
           CASE WHEN strlen(content) <= 1024 THEN 'hot' WHEN strlen(content) <= 4096 THEN 'warm' ELSE 'cold' END AS tier, k * 3600000 + {EPOCH_MS} AS mtime, k * 3600000 + {EPOCH_MS} + (k % 7) * 86400000 AS atime
    FROM regular
    UNION ALL
    SELECT DISTINCT path, 'directory', 493, 0, 0, 0, NULL, 'hot', {EPOCH_MS}, {EPOCH_MS}
    FROM (SELECT unnest(list_concat(['/'], list_transform(range(2, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[1:n], '/')))) AS path FROM regular)
  )""",
    "blobs": """
  SELECT blob_id AS id, max(size) AS size, count(*) AS ref_count, min(mtime) AS created_at, CASE WHEN max(size) <= 1024 THEN 'hot' WHEN max(size) <= 4096 THEN 'warm' ELSE 'cold' END AS tier
  FROM files WHERE type = 'file' GROUP BY blob_id""",
    "page_metadata": """
  SELECT l_orderkey AS file_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS page_number,
         l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS page_key,
         CASE l_returnflag WHEN 'R' THEN 'hot' WHEN 'A' THEN 'warm' ELSE 'cold' END AS tier, (l_quantity * 4096)::BIGINT AS size, l_quantity::BIGINT % 7 AS access_count, epoch_us(l_shipdate) // 1000 AS last_access_at
  FROM lineitem""",
    "watch_events": """
  SELECT event_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' ELSE 'modify' END AS type,
         '/u/' || user_id || '/' || (event_id % 3) || '.dat' AS path, user_id, ts
  FROM events""",
    "branches": """
  SELECT * FROM (VALUES ('main', NULL), ('dev', 'main'), ('feature', 'dev'), ('hotfix', 'main')) t(name, parent)""",
    "branch_files": """
  SELECT branch, file_id, size, deleted, commit, modified_at FROM (
    SELECT ['main', 'dev', 'feature', 'hotfix'][o_orderkey % 4 + 1] AS branch, 'f' || (o_orderkey % 500) AS file_id, trunc(o_totalprice)::BIGINT AS size, o_orderstatus = 'F' AS deleted, o_orderkey AS commit, o_orderdate AS modified_at,
           row_number() OVER (PARTITION BY o_orderkey % 4, o_orderkey % 500 ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
    FROM orders) WHERE r = 1""",
    "ancestry": """
  SELECT name AS branch, name AS owner, 0 AS distance FROM branches
  UNION ALL SELECT a.branch, b.parent, a.distance + 1 FROM ancestry a JOIN branches b ON b.name = a.owner WHERE b.parent IS NOT NULL""",
}
NEEDS = {"files": ["regular"], "blobs": ["files"], "ancestry": ["branches"]}


def with_ctes(body: str) -> str:
    """The SQL with what it names of the catalog before it."""
    wanted: list[str] = []

    def want(name: str) -> None:
        for other in NEEDS.get(name, []):
            want(other)
        if name not in wanted:
            wanted.append(name)

    for name in CTES:
        if re.search(rf"\b{name}\b", body):
            want(name)
    if not wanted:
        return body
    head = ", ".join(f"{n} AS ({CTES[n]}\n)" for n in wanted)
    more = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    recursive = "RECURSIVE " if "ancestry" in wanted or (more and more[1]) else ""
    return f"WITH {recursive}{head}" + (f", {body[more.end():]}" if more else f"\n{body}")


def query(name: str, sql: str | None = None, *more: str) -> Callable:
    """Register a function of a Catalog as a query, also under further names."""

    def add(f: Callable[[Catalog], DataFrame]) -> Callable:
        for n in (name, *more):
            QUERIES[n] = lambda spark, folder: f(Catalog(spark, folder))
            if sql:
                SQL[n] = with_ctes(sql.replace("{now}", str(NOW_MS)))
        return f

    return add
