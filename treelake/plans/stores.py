"""Queries D31-D33, F14-F15, M01, M13, P35, S10, D27-D28: tiered objects, extents, links, flags, fetches and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.functions import extents
from treelake.operators import branching, changes, find, storage, tiering
from treelake.plans.registry import query
from treelake.sources.catalog import NOW_MS, Catalog

DAY = 86_400_000
#: The tables' times are years old.
OLD = storage.TierConfig(hot_max=40_960, warm_max=122_880, hot_age_ms=9_700 * DAY, warm_age_ms=10_000 * DAY)

#: Pages as objects; those used three times are held by the cold tier as well.
OBJECTS = "objects AS (SELECT page_key AS key, tier, size, access_count, last_access_at FROM page_metadata UNION ALL SELECT page_key, 'cold', size, 1, last_access_at FROM page_metadata WHERE access_count = 3 AND tier <> 'cold')"
RANKED = f"{OBJECTS}, ranked AS (SELECT *, CASE tier WHEN 'hot' THEN 0 WHEN 'warm' THEN 1 ELSE 2 END AS rank FROM objects), located AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank, size, access_count, last_access_at) = 1)"
ASKED = "asked AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS key, sum(1 + l_linenumber % 2)::BIGINT AS reads FROM lineitem GROUP BY 1 UNION ALL SELECT 'none:' || o_orderkey, 1 FROM orders WHERE o_orderkey % 50 = 0)"
READ = f"""{RANKED}, {ASKED}, judged AS (SELECT a.key, reads, o.tier, coalesce(o.tier <> 'hot' AND ({{now}} - last_access_at < {OLD.hot_age_ms} OR (access_count > 5 AND {{now}} - last_access_at < {OLD.warm_age_ms})), false) AS migrated FROM asked a LEFT JOIN located o ON o.key = a.key),
results AS (SELECT key, reads, CASE WHEN NOT migrated THEN tier WHEN tier = 'cold' THEN 'warm' ELSE 'hot' END AS tier, CASE WHEN migrated THEN tier END AS previous_tier, migrated, CASE WHEN tier IS NULL THEN 'ENOENT' END AS error FROM judged)"""


def objects(c: Catalog) -> DataFrame:
    p = c.page_metadata.select(F.col("page_key").alias("key"), "tier", "size", "access_count", "last_access_at")
    more = p.where("access_count = 3 AND tier <> 'cold'").withColumns({"tier": F.lit("cold"), "access_count": F.lit(1).cast("long")})
    return p.unionByName(more)


def asked(c: Catalog) -> DataFrame:
    """Keys to read, some of them twice, some that nothing holds."""
    rows = c.table("lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), F.explode(F.sequence(F.lit(0), (F.col("l_linenumber") % 2).cast("int"))).alias("n")).drop("n")
    return rows.unionByName(c.table("orders").where("o_orderkey % 50 = 0").select(F.concat(F.lit("none:"), F.col("o_orderkey").cast("string")).alias("key")))


@query("d32_promoting_read", f"WITH {READ} SELECT * FROM results")
def promoting_read(c: Catalog) -> DataFrame:
    return tiering.read(objects(c), asked(c), NOW_MS, OLD).withColumn("reads", F.col("reads").cast("long"))


@query(
    "d32_after_reads",
    f"""WITH {READ}, kept AS (SELECT o.* FROM objects o LEFT JOIN results r ON r.key = o.key AND r.migrated WHERE r.key IS NULL OR o.tier NOT IN (r.tier, r.previous_tier)),
moved AS (SELECT * FROM kept UNION ALL SELECT l.key, r.tier, l.size, l.access_count, l.last_access_at FROM located l JOIN results r ON r.key = l.key AND r.migrated)
SELECT m.key, m.tier, m.size, m.access_count + CASE WHEN m.tier = r.tier THEN reads ELSE 0 END AS access_count, CASE WHEN m.tier = r.tier THEN {{now}} ELSE last_access_at END AS last_access_at FROM moved m LEFT JOIN results r ON r.key = m.key""",
)
def after_reads(c: Catalog) -> DataFrame:
    rows = objects(c)
    return tiering.after_reads(rows, tiering.read(rows, asked(c), NOW_MS, OLD), NOW_MS)


def _targets(c: Catalog, names: tuple[str, str, str]) -> DataFrame:
    target = F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("l_partkey") % 3 + 1).cast("int"))
    found = c.table("lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), target.alias("target")).distinct()
    return found.unionByName(c.table("orders").where("o_orderkey % 50 = 0").select(F.concat(F.lit("none:"), F.col("o_orderkey").cast("string")).alias("key"), F.lit(names[0]).alias("target")))


def _shift_sql(names: tuple[str, str, str], test: str) -> str:
    a, b, bad = names
    keys = f"wanted AS (SELECT DISTINCT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS key, ['{a}', '{b}', '{bad}'][l_partkey % 3 + 1] AS target FROM lineitem UNION ALL SELECT 'none:' || o_orderkey, '{a}' FROM orders WHERE o_orderkey % 50 = 0)"
    return f"""WITH {RANKED}, {keys}, judged AS (SELECT w.key, w.target, tier, coalesce(target <> '{bad}' AND rank {test} CASE target WHEN 'hot' THEN 0 WHEN 'warm' THEN 1 ELSE 2 END, false) AS migrated FROM wanted w LEFT JOIN located l ON l.key = w.key),
results AS (SELECT key, CASE WHEN migrated THEN target ELSE tier END AS tier, CASE WHEN migrated THEN tier END AS previous_tier, migrated, CASE WHEN target = '{bad}' THEN 'EINVAL' WHEN tier IS NULL THEN 'ENOENT' END AS error FROM judged)"""


UP, DOWN = ("hot", "warm", "cold"), ("warm", "cold", "hot")
SETTLED = """kept AS (SELECT o.* FROM objects o LEFT JOIN results r ON r.key = o.key AND r.migrated WHERE r.key IS NULL OR o.tier NOT IN (r.tier, r.previous_tier))
SELECT key, tier, size, access_count, last_access_at FROM kept UNION ALL SELECT l.key, r.tier, l.size, l.access_count, l.last_access_at FROM located l JOIN results r ON r.key = l.key AND r.migrated"""


@query("d33_promote", f"{_shift_sql(UP, '>')} SELECT * FROM results")
def promote(c: Catalog) -> DataFrame:
    return tiering.promote(objects(c), _targets(c, UP))


@query("d33_demote", f"{_shift_sql(DOWN, '<')} SELECT * FROM results")
def demote(c: Catalog) -> DataFrame:
    return tiering.demote(objects(c), _targets(c, DOWN))


@query("d33_settled", f"{_shift_sql(DOWN, '<')}, {SETTLED}")
def settled(c: Catalog) -> DataFrame:
    rows = objects(c)
    return tiering.settle(rows, tiering.demote(rows, _targets(c, DOWN)))


#: Every seventh order's pages get new keys.
PAIRS = "pairs AS (SELECT DISTINCT page_key AS source, 'to:' || page_key AS dest FROM page_metadata WHERE file_id % 7 = 0)"


def _pairs(c: Catalog) -> DataFrame:
    return c.page_metadata.where("file_id % 7 = 0").select(F.col("page_key").alias("source"), F.concat(F.lit("to:"), "page_key").alias("dest")).distinct()


@query(
    "d31_write",
    f"WITH {OBJECTS}, fresh AS (SELECT page_key AS key, max(size) + 1 AS size, CASE WHEN max(size) + 1 <= 40960 THEN 'hot' WHEN max(size) + 1 <= 122880 THEN 'warm' ELSE 'cold' END AS tier FROM page_metadata WHERE file_id % 7 = 0 GROUP BY page_key) SELECT o.* FROM objects o LEFT JOIN fresh f ON f.key = o.key AND f.tier = o.tier WHERE f.key IS NULL UNION ALL SELECT key, tier, size, 0, {{now}} FROM fresh",
)
def write(c: Catalog) -> DataFrame:
    rows = c.page_metadata.where("file_id % 7 = 0").groupBy(F.col("page_key").alias("key")).agg((F.max("size") + 1).alias("size"))
    return tiering.write(objects(c), rows, NOW_MS, OLD)


@query("d31_copy", f"WITH {RANKED}, {PAIRS} SELECT key, tier, size, access_count, last_access_at FROM objects UNION ALL SELECT dest, CASE WHEN hash % 2 = 0 THEN 'cold' ELSE tier END, size, 0, {{now}} FROM (SELECT *, strlen(source) AS hash FROM pairs) JOIN located ON key = source")
def copy(c: Catalog) -> DataFrame:
    rows = objects(c)
    pairs = _pairs(c).withColumn("tier", F.when(F.length("source") % 2 == 0, "cold"))
    return tiering.put(rows, tiering.copies(rows, pairs, NOW_MS))


@query("d31_move", f"WITH {RANKED}, {PAIRS} SELECT o.key, o.tier, o.size, o.access_count, o.last_access_at FROM objects o LEFT JOIN pairs ON source = o.key LEFT JOIN located l ON l.key = o.key WHERE source IS NULL OR o.tier <> l.tier UNION ALL SELECT dest, tier, size, 0, {{now}} FROM pairs JOIN located ON key = source")
def move(c: Catalog) -> DataFrame:
    return tiering.move(objects(c), _pairs(c), NOW_MS)


@query("d31_delete", f"WITH {RANKED}, {PAIRS} SELECT o.key, o.tier, o.size, o.access_count, o.last_access_at FROM objects o LEFT JOIN pairs ON source = o.key LEFT JOIN located l ON l.key = o.key WHERE source IS NULL OR o.tier <> l.tier")
def delete(c: Catalog) -> DataFrame:
    return tiering.delete(objects(c), _pairs(c).select(F.col("source").alias("key")))


#: Contents as pages of 64 bytes filled with spaces, eight slots to an extent, every fifth page missing.
EXTENTS = """p AS (SELECT path, n, n % 8 AS slot FROM regular, unnest(range((strlen(content) + 63) // 64)) t(n) WHERE n % 5 <> 3)"""


def _extents(c: Catalog) -> DataFrame:
    n = F.ceil(F.octet_length("content") / 64).cast("int")
    b = F.col("content").cast("binary")
    rows = c.contents.where(F.octet_length("content") > 0).select("path", b.alias("b"), F.explode(F.sequence(F.lit(0), n - 1)).alias("n")).where("n % 5 <> 3")
    part = F.substring(F.col("b"), F.col("n") * 64 + 1, F.lit(64))
    rows = rows.select("path", F.floor(F.col("n") / 8).alias("extent"), F.struct((F.col("n") % 8).alias("slot"), F.rpad(part, 64, b" ").alias("data")).alias("page"))
    return rows.groupBy("path", "extent").agg(F.collect_list("page").alias("pages")).select("path", "extent", extents.build(F.col("pages"), 64).alias("data"))


@query(
    "f15_extents",
    f"WITH {EXTENTS} SELECT path, n // 8 AS extent, 1 AS version, max(slot) + 1 AS page_count, count(*) * 64 AS extent_size, 64 + 1 + count(*) * 64 AS bytes, list(slot ORDER BY slot)::VARCHAR AS slots, lower(printf('%02x', sum(1 << slot)::BIGINT)) AS bitmap, path NOT LIKE '%7.%' AS valid FROM p GROUP BY path, n // 8",
)
def packed(c: Catalog) -> DataFrame:
    """Headers, bitmaps and validity; one page byte of every path with a 7 before its suffix is changed after packing."""
    hurt = F.when(F.col("path").like("%7.%"), F.concat(F.substring(F.col("data"), F.lit(1), F.octet_length("data") - 1), F.lit(b"\0"))).otherwise(F.col("data"))
    rows = extents.validate(_extents(c).withColumn("data", hurt))
    h = extents.header(F.col("data"))
    return rows.select(
        "path", "extent", h["version"].alias("version"), h["page_count"].alias("page_count"), h["extent_size"].alias("extent_size"), F.octet_length("data").cast("long").alias("bytes"),
        F.concat(F.lit("["), F.array_join(extents.present(F.col("data")).cast("array<string>"), ", "), F.lit("]")).alias("slots"), F.lower(F.hex(F.substring(F.col("data"), 65, 1))).alias("bitmap"), "valid",
    )


@query("f14_page_of_extent", f"WITH {EXTENTS}, e AS (SELECT path, n // 8 AS extent FROM p GROUP BY 1, 2) SELECT e.path, e.extent, n IS NOT NULL AS present, lower(hex(encode(content)[n * 64 + 1 : n * 64 + 64])) || repeat('20', greatest(0, 64 - greatest(0, strlen(content) - n * 64))::INT) AS page FROM e JOIN regular r ON r.path = e.path LEFT JOIN p ON p.path = e.path AND p.n = e.extent * 8 + 2")
def page_of_extent(c: Catalog) -> DataFrame:
    x, two = F.col("data"), F.lit(2)
    return _extents(c).select("path", "extent", extents.has_page(x, two).alias("present"), F.lower(F.hex(extents.page(x, two))).alias("page"))


#: Writes to pages that are there or not, with each flag, to a directory, and below a file and a missing directory.
WRITES = "w AS (SELECT page_id * 10 + f AS seq, CASE f WHEN 5 THEN '/docs' WHEN 6 THEN '/web/' || page_id || '.html/x' WHEN 7 THEN '/no/' || page_id ELSE '/web/' || (page_id * 2 - page_id % 2) || '.html' END AS path, ['w', 'wx', 'a', 'ax', 'r', 'w', 'w', 'a'][f + 1] AS flag, page_id AS size FROM pages, range(8) t(f))"


@query(
    "m01_write_flags",
    f"WITH {WRITES}, f AS (SELECT w.*, row_number() OVER (PARTITION BY path ORDER BY seq) = 1 AS first FROM w) SELECT seq, f.path, CASE WHEN flag = 'r' THEN 'EINVAL' WHEN o.type = 'directory' THEN 'EISDIR' WHEN f.path LIKE '/no/%' OR f.path LIKE '%/x' THEN 'ENOENT' WHEN flag IN ('wx', 'ax') AND (o.type = 'file' OR NOT first) THEN 'EEXIST' ELSE 'ok' END AS status, CASE WHEN status = 'ok' THEN f.size + CASE WHEN flag = 'a' THEN coalesce(o.size, 0) ELSE 0 END END AS size FROM f LEFT JOIN files o ON o.path = f.path",
)
def write_flags(c: Catalog) -> DataFrame:
    k, f = F.col("page_id"), F.col("f")
    s = lambda x: x.cast("string")
    rows = c.table("pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("f"))
    path = F.when(f == 5, "/docs").when(f == 6, F.concat(F.lit("/web/"), s(k), F.lit(".html/x"))).when(f == 7, F.concat(F.lit("/no/"), s(k))).otherwise(F.concat(F.lit("/web/"), s(k * 2 - k % 2), F.lit(".html")))
    flag = F.element_at(F.array(*(F.lit(x) for x in ("w", "wx", "a", "ax", "r", "w", "w", "a"))), f + 1)
    return changes.write_status(c.files, rows.select((k * 10 + f).alias("seq"), path.alias("path"), flag.alias("flag"), k.alias("size")))


def _link_requests(c: Catalog, first: str) -> DataFrame:
    k = F.col("page_id")
    s = lambda x: x.cast("string")
    there = F.concat(F.lit("/web/"), s(k), F.lit(".html"))
    path = F.when(k % 4 == 0, there).when(k % 4 == 1, F.concat(F.lit("/no/"), s(k))).otherwise(F.concat(F.lit("/web/l"), s(F.floor(k / 8))))
    source = F.when(k % 11 == 0, "" if first == "target" else "/web").when(k % 13 == 0, "/gone").otherwise(there)
    return c.table("pages").select(k.alias("seq"), source.alias(first), path.alias("path"))


def _links_sql(empty: str) -> str:
    return f"""r AS (SELECT page_id AS seq, CASE WHEN page_id % 11 = 0 THEN '{empty}' WHEN page_id % 13 = 0 THEN '/gone' ELSE '/web/' || page_id || '.html' END AS source, CASE page_id % 4 WHEN 0 THEN '/web/' || page_id || '.html' WHEN 1 THEN '/no/' || page_id ELSE '/web/l' || (page_id // 8) END AS path FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) = 1 AS first FROM r)"""


@query("m13_symlink", f"WITH {_links_sql('')} SELECT seq, f.path, source AS target, CASE WHEN source = '' THEN 'EINVAL' WHEN o.path IS NOT NULL OR NOT first THEN 'EEXIST' WHEN f.path LIKE '/no/%' THEN 'ENOENT' ELSE 'ok' END AS status FROM f LEFT JOIN files o ON o.path = f.path")
def symlink(c: Catalog) -> DataFrame:
    return changes.symlinks(c.files, _link_requests(c, "target"))


@query(
    "m13_hard_link",
    f"""WITH {_links_sql('/web')}, j AS (SELECT seq, f.path, CASE WHEN s.path IS NULL THEN 'ENOENT' WHEN s.type = 'directory' THEN 'EPERM' WHEN o.path IS NOT NULL OR NOT first THEN 'EEXIST' WHEN f.path LIKE '/no/%' THEN 'ENOENT' ELSE 'ok' END AS status, s.id AS sid FROM f LEFT JOIN files o ON o.path = f.path LEFT JOIN files s ON s.path = source)
SELECT seq, path, status, CASE WHEN status = 'ok' THEN sid END AS id, CASE WHEN status = 'ok' THEN 1 + count(*) FILTER (status = 'ok') OVER (PARTITION BY sid) END AS nlink FROM j""",
)
def hard_link(c: Catalog) -> DataFrame:
    return changes.hard_links(c.files, _link_requests(c, "existing"))


@query(
    "p35_fetch",
    """WITH q AS (SELECT path AS resource FROM files WHERE type = 'directory' OR path LIKE '%3.html' UNION ALL SELECT '/none/' || page_id FROM pages),
below AS (SELECT resource, f.path, f.depth - d.depth AS level, f.type, f.size FROM q JOIN files d ON d.path = resource JOIN files f ON f.path = resource OR (d.type = 'directory' AND f.depth - d.depth BETWEEN 1 AND 2 AND starts_with(f.path, rtrim(resource, '/') || '/') AND NOT regexp_matches(f.path[strlen(rtrim(resource, '/')) + 1 :], '/\\.')))
SELECT resource, b.path, level, type, size, CASE WHEN type = 'file' AND level = 0 THEN 'text/html' END AS content_type, sha256(content) AS sha256, NULL AS error FROM below b LEFT JOIN regular r ON level = 0 AND r.path = b.path
UNION ALL SELECT resource, NULL, NULL, NULL, NULL, NULL, NULL, 'ENOENT' FROM q WHERE resource NOT IN (SELECT path FROM files)""",
)
def fetch(c: Catalog) -> DataFrame:
    """All directories, some pages and as many missing paths; contents as digests."""
    wanted = c.files.where(F.col("path").like("%3.html") | (F.col("type") == "directory")).select("path").unionByName(c.table("pages").select(F.concat(F.lit("/none/"), F.col("page_id").cast("string")).alias("path")))
    return find.fetch(c.files, c.contents, wanted).withColumn("content", F.sha2("content", 256)).withColumnRenamed("content", "sha256")


@query(
    "s10_list_page",
    "WITH k AS (SELECT page_key, size FROM page_metadata WHERE starts_with(page_key, '1') AND page_key > '12' ORDER BY page_key LIMIT 51) SELECT page_key, size, count(*) OVER () > 50 AS truncated, CASE WHEN count(*) OVER () > 50 THEN (SELECT page_key FROM k ORDER BY page_key LIMIT 1 OFFSET 49) END AS cursor FROM k ORDER BY page_key LIMIT 50",
)
def list_page(c: Catalog) -> DataFrame:
    rows, cursor, truncated = find.list_page(c.page_metadata, "page_key", "1", 50, "12")
    return rows.select("page_key", "size", F.lit(truncated).alias("truncated"), F.lit(cursor).cast("string").alias("cursor"))


SEEN = "best AS (SELECT a.branch, f.file_id, owner, size, deleted, f.commit, row_number() OVER (PARTITION BY a.branch, f.file_id ORDER BY distance) AS r FROM branch_files f JOIN ancestry a ON a.owner = f.branch)"
EDITS = "edits AS (SELECT ['main', 'dev', 'feature', 'hotfix'][c_custkey % 4 + 1] AS branch, 'f' || c_custkey AS file_id, c_custkey AS size, c_custkey % 5 = 0 AS deleted FROM customer)"


def _edits(c: Catalog) -> DataFrame:
    k = F.col("c_custkey")
    names = F.array(*(F.lit(n) for n in ("main", "dev", "feature", "hotfix")))
    return c.table("customer").select(F.element_at(names, (k % 4 + 1).cast("int")).alias("branch"), F.concat(F.lit("f"), k.cast("string")).alias("file_id"), k.cast("long").alias("size"), (k % 5 == 0).alias("deleted"))


WRITTEN = f"{SEEN}, {EDITS}, written AS (SELECT e.*, b.owner = e.branch AS was_own, b.owner <> e.branch AND NOT b.deleted AS copied_from_parent, CASE WHEN NOT b.deleted THEN b.commit END AS previous FROM edits e LEFT JOIN best b ON b.branch = e.branch AND b.file_id = e.file_id AND b.r = 1), taken AS (SELECT branch, file_id, size, deleted, coalesce(was_own, false) AS was_own, coalesce(copied_from_parent, false) AS copied_from_parent, previous FROM written WHERE NOT deleted OR previous IS NOT NULL)"


@query("d27_cow_write", f"WITH {WRITTEN} SELECT branch, file_id, CASE WHEN deleted THEN 0 ELSE size END AS size, deleted, was_own, copied_from_parent, previous FROM taken")
def cow_write(c: Catalog) -> DataFrame:
    return branching.write(c.branch_files, c.branches, _edits(c))


@query("d28_commit", f"WITH {WRITTEN} SELECT branch, count(*) AS paths, sum(CASE WHEN deleted THEN 0 ELSE size END)::BIGINT AS bytes, count(*) FILTER (deleted) AS tombstones FROM taken GROUP BY branch")
def cow_commit(c: Catalog) -> DataFrame:
    return branching.commit(branching.write(c.branch_files, c.branches, _edits(c)))
