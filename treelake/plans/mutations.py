"""Queries M, D23-D39, W: change sets, branches, events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.operators import branching as br
from treelake.operators import changes as ch
from treelake.plans.registry import query
from treelake.sources.catalog import NOW_MS, Catalog
from treelake.streaming import sequential, watch


@query("m01_apply", "SELECT path, CASE WHEN path LIKE '%1.html' THEN 7 ELSE size END AS size FROM files WHERE NOT path LIKE '%2.html' UNION ALL SELECT '/new/' || page_id, page_id FROM pages")
def apply(c: Catalog) -> DataFrame:
    base = c.files.select("path", "size")
    put = c.files.where(F.col("path").like("%1.html")).select(F.lit(5).alias("seq"), F.lit("put").alias("op"), "path", F.lit(7).cast("long").alias("size"))
    early = put.withColumn("seq", F.lit(1)).withColumn("op", F.lit("delete"))
    gone = c.files.where(F.col("path").like("%2.html")).select(F.lit(3).alias("seq"), F.lit("delete").alias("op"), "path", "size")
    new = c.table("pages").select(F.lit(2).alias("seq"), F.lit("put").alias("op"), F.concat(F.lit("/new/"), F.col("page_id").cast("string")).alias("path"), F.col("page_id").alias("size"))
    return ch.apply(base, put.unionByName(early).unionByName(gone).unionByName(new))


@query("m02_append", "SELECT path, sha256(content || CASE WHEN path LIKE '%7.%' THEN '+tail' ELSE '' END) AS sha256 FROM regular", "m02_append_all")
def append_all(c: Catalog) -> DataFrame:
    more = c.contents.where(F.col("path").like("%7.%")).select("path", F.lit("+tail").alias("data"))
    return ch.append(c.contents, more).select("path", F.sha2("content", 256).alias("sha256"))


@query("m04_truncate", "SELECT path, lower(hex(encode(content)[1:100])) || repeat('00', greatest(100 - strlen(content), 0)::INT) AS data FROM regular", "m04_truncate_all")
def truncate_all(c: Catalog) -> DataFrame:
    return ch.truncate(c.contents, 100).select("path", F.lower(F.hex("content")).alias("data"))


@query("m05_copy", "SELECT '/copy' || path[5:] AS path, blob_id FROM files WHERE path = '/web' OR starts_with(path, '/web/')")
def copy(c: Catalog) -> DataFrame:
    return ch.copy_tree(c.files, "/web", "/copy").select("path", "blob_id")


@query(
    "m06_rename",
    """WITH m AS (SELECT CASE WHEN path = '/docs/src1' OR starts_with(path, '/docs/src1/') THEN '/moved' || path[11:] ELSE path END AS path, size FROM files)
SELECT path, CASE WHEN path = '/' THEN '/' ELSE string_split(path, '/')[-1] END AS name, CASE WHEN path = '/' THEN 0 ELSE len(string_split(path, '/')) - 1 END AS depth, size FROM m""",
)
def rename(c: Catalog) -> DataFrame:
    return ch.rename(c.files, "/docs/src1", "/moved").select("path", "name", "depth", "size")


@query(
    "m07_mkdir",
    """WITH w AS (SELECT DISTINCT '/docs/new' || (page_id % 3) || '/' || (page_id % 7) AS path FROM pages),
e AS (SELECT path FROM w UNION SELECT '/docs/' || string_split(path, '/')[3] FROM w UNION SELECT '/docs' UNION SELECT '/') SELECT path FROM e WHERE path NOT IN (SELECT path FROM files)""",
)
def mkdir(c: Catalog) -> DataFrame:
    k = F.col("page_id")
    return ch.make_directories(c.files, c.table("pages").select(F.concat(F.lit("/docs/new"), (k % 3).cast("string"), F.lit("/"), (k % 7).cast("string")).alias("path")))


@query("m08_remove", "SELECT path FROM files WHERE path <> '/docs/src3' AND NOT starts_with(path, '/docs/src3/')")
def remove(c: Catalog) -> DataFrame:
    return ch.remove(c.files, "/docs/src3", recursive=True).select("path")


@query("m09_unlink", "SELECT path FROM files WHERE NOT (type = 'file' AND size > 5000)")
def unlink(c: Catalog) -> DataFrame:
    return ch.unlink(c.files, c.files.where("type = 'file' AND size > 5000")).select("path")


@query("m10_chmod", "SELECT path, (((mode & ~18) | 64 | 73) & ~7) | 4 AS mode FROM files")
def chmod(c: Catalog) -> DataFrame:
    return ch.chmod(c.files, "go-w,u+x,a+X,o=r", F.lit(True)).select("path", "mode")


@query("m11_chown", "SELECT path, CASE WHEN uid = 1 THEN 50 ELSE uid END AS uid, CASE WHEN uid = 1 THEN 60 ELSE gid END AS gid FROM files")
def chown(c: Catalog) -> DataFrame:
    return ch.chown(c.files, 50, 60, F.col("uid") == 1).select("path", "uid", "gid")


@query("m12_utimes", "SELECT path, CASE WHEN type = 'file' THEN 1700000000000 ELSE mtime END AS mtime, CASE WHEN type = 'file' THEN 1700000000001 ELSE atime END AS atime FROM files")
def utimes(c: Catalog) -> DataFrame:
    return ch.utimes(c.files, F.lit(1_700_000_000_001), F.lit(1_700_000_000), F.col("type") == "file").select("path", "mtime", "atime")


@query("m13_link_counts", "SELECT blob_id, count(*) AS nlink FROM files WHERE type = 'file' GROUP BY blob_id")
def link_counts(c: Catalog) -> DataFrame:
    return ch.link_counts(c.files.where("type = 'file'"), "blob_id")


@query("m17_bulk_delete", "SELECT id FROM blobs WHERE size > 300")
def bulk_delete(c: Catalog) -> DataFrame:
    small = c.blobs.where("size <= 300").select(F.col("id").alias("path"))
    return ch.unlink(c.blobs.select(F.col("id").alias("path")), small).select(F.col("path").alias("id"))


@query("m18_partial_update", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def partial_update(c: Catalog) -> DataFrame:
    s = c.table("supplier").select("s_suppkey", "s_name", "s_acctbal")
    u = s.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit(None).cast("string").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    return ch.partial_update(s, u, "s_suppkey")


@query(
    "m19_upsert",
    "SELECT coalesce(s.s_name, n.key) AS key, coalesce(n.value, s.s_acctbal) AS value, CASE WHEN s.s_name IS NULL THEN {now} ELSE 5 END AS created_at, CASE WHEN n.key IS NULL THEN 6 ELSE {now} END AS updated_at FROM supplier s FULL JOIN (SELECT 'Supplier#' || lpad((s_suppkey + 50)::VARCHAR, 9, '0') AS key, 1.0::DOUBLE AS value FROM supplier) n ON n.key = s.s_name",
)
def upsert(c: Catalog) -> DataFrame:
    base = c.table("supplier").select(F.col("s_name").alias("key"), F.col("s_acctbal").alias("value"), F.lit(5).cast("long").alias("created_at"), F.lit(6).cast("long").alias("updated_at"))
    new = c.table("supplier").select(F.concat(F.lit("Supplier#"), F.lpad((F.col("s_suppkey") + 50).cast("string"), 9, "0")).alias("key"), F.lit(1.0).alias("value"))
    return ch.upsert(base, new, NOW_MS)


@query(
    "m20_upsert_entities",
    "SELECT coalesce(p.p_partkey, n.p_partkey) AS p_partkey, coalesce(n.p_size, p.p_size) AS p_size, CASE WHEN n.p_partkey IS NULL THEN 1 WHEN p.p_partkey IS NULL THEN 1 ELSE 2 END AS version, CASE WHEN n.p_partkey IS NULL THEN 0 ELSE {now} END AS updated_at FROM part p FULL JOIN (SELECT p_partkey + 100 AS p_partkey, p_size + 1 AS p_size FROM part) n ON n.p_partkey = p.p_partkey",
)
def upsert_entities(c: Catalog) -> DataFrame:
    p = c.table("part").select("p_partkey", "p_size")
    base = p.withColumns({"version": F.lit(1), "updated_at": F.lit(0).cast("long")})
    return ch.upsert_entities(base, p.select((F.col("p_partkey") + 100).alias("p_partkey"), (F.col("p_size") + 1).alias("p_size")), "p_partkey", NOW_MS)


@query("m27_batch_status", "WITH r AS (SELECT '/web/' || page_id * 2 || '.html' AS path FROM pages UNION ALL SELECT '/docs') SELECT r.path, CASE WHEN type IS NULL THEN 'ENOENT' WHEN type = 'directory' THEN 'EISDIR' ELSE 'ok' END AS status FROM r LEFT JOIN files f ON f.path = r.path")
def batch_status(c: Catalog) -> DataFrame:
    asked = c.table("pages").select(F.concat(F.lit("/web/"), (F.col("page_id") * 2).cast("string"), F.lit(".html")).alias("path"))
    return ch.batch_status(c.files, asked.unionByName(c.spark.createDataFrame([("/docs",)], "path string")))


@query("t11_operation_order", "SELECT event_id AS seq, ['write', 'mkdir', 'rmdir', 'rm', 'rename'][event_id % 5 + 1] AS op, [1, 0, 4, 3, 2][event_id % 5 + 1] AS rank FROM events")
def operation_order(c: Catalog) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("write", "mkdir", "rmdir", "rm", "rename")))
    return ch.ordered(c.table("events").select(F.col("event_id").alias("seq"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("op")))


RESOLVED = "best AS (SELECT a.branch, f.file_id, owner, size, deleted, row_number() OVER (PARTITION BY a.branch, f.file_id ORDER BY distance) AS r FROM branch_files f JOIN ancestry a ON a.owner = f.branch)"


@query("j05_ancestry", "SELECT branch, owner, distance FROM ancestry")
def ancestry(c: Catalog) -> DataFrame:
    return br.ancestry(c.branches)


@query("d23_branch_read", f"WITH {RESOLVED} SELECT branch, file_id, owner, size, deleted FROM best WHERE r = 1")
def branch_read(c: Catalog) -> DataFrame:
    return br.resolve(c.branch_files, c.branches).drop("commit")


@query("d24_branch_files", f"WITH {RESOLVED} SELECT file_id, owner, size FROM best WHERE r = 1 AND NOT deleted AND branch = 'feature'")
def branch_files(c: Catalog) -> DataFrame:
    return br.live(c.branch_files, c.branches, "feature").select("file_id", "owner", "size")


@query("d25_branch_sizes", f"WITH {RESOLVED} SELECT branch, file_id, CASE WHEN deleted THEN 0 ELSE size END AS size FROM best WHERE r = 1")
def branch_sizes(c: Catalog) -> DataFrame:
    return br.sizes(c.branch_files, c.branches)


@query("d26_snapshot", "SELECT branch, count(*) AS files, '[' || string_agg('{\"file_id\":\"' || file_id || '\",\"size\":' || size || '}', ',' ORDER BY file_id) || ']' AS snapshot FROM branch_files WHERE NOT deleted GROUP BY branch")
def snapshot(c: Catalog) -> DataFrame:
    return br.snapshot(c.branch_files).withColumn("files", F.col("files").cast("long"))


@query(
    "d39_dirty",
    f"WITH {RESOLVED}, view AS (SELECT branch, file_id FROM best WHERE r = 1 AND NOT deleted) SELECT f.branch, f.file_id, CASE WHEN f.deleted THEN 'deleted' WHEN v.file_id IS NOT NULL THEN 'changed' ELSE 'added' END AS kind FROM branch_files f JOIN branches b ON b.name = f.branch LEFT JOIN view v ON v.branch = b.parent AND v.file_id = f.file_id",
)
def dirty(c: Catalog) -> DataFrame:
    return br.dirty(c.branch_files, c.branches)


@query("w02_subscriptions", "SELECT event_id, s.connection FROM watch_events JOIN (VALUES ('a'), ('b'), ('c')) s(connection) ON CASE connection WHEN 'a' THEN regexp_matches(path, '^/u/1[^/]*/[^/]*\\.dat$') WHEN 'b' THEN starts_with(path, '/u/') WHEN 'c' THEN path = '/u/7/0.dat' END")
def subscriptions(c: Catalog) -> DataFrame:
    return watch.match_subscriptions(c.watch_events, [("a", "/u/1*/*.dat"), ("b", "/u/**"), ("b", "/u/1*/*.dat"), ("c", "/u/7/0.dat")]).select("event_id", "connection")


@query(
    "w03_subscription_limit",
    """WITH p AS (SELECT user_id AS connection, path AS pattern, min(event_id) AS place FROM watch_events GROUP BY 1, 2)
SELECT connection, pattern, place FROM p QUALIFY row_number() OVER (PARTITION BY connection ORDER BY place) <= 2""",
)
def subscription_limit(c: Catalog) -> DataFrame:
    asked = c.watch_events.select(F.col("user_id").alias("connection"), F.concat("path", F.lit("/")).alias("pattern"), "event_id")
    return watch.accepted(asked, "event_id", 2)


@query(
    "w04_watchers",
    "SELECT event_id, 'all' AS watcher, path[4:] AS filename FROM watch_events UNION ALL SELECT event_id, 'seven', string_split(path, '/')[-1] FROM watch_events WHERE starts_with(path, '/u/7/') UNION ALL SELECT event_id, 'one', '0.dat' FROM watch_events WHERE path = '/u/5/0.dat'",
)
def watchers(c: Catalog) -> DataFrame:
    return watch.match_watchers(c.watch_events, [("all", "/u", True), ("seven", "/u/7", False), ("one", "/u/5/0.dat", False), ("none", "/u", False)]).select("event_id", "watcher", "filename")


BURSTS = """gaps AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY path ORDER BY ts, event_id) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM watch_events),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM gaps),
bursts AS (SELECT path, burst, epoch_us(min(ts)) // 1000 AS started, epoch_us(max(ts)) // 1000 AS last, count(*) AS events, CASE WHEN arg_min(type, (ts, event_id)) = 'rename' OR arg_max(type, (ts, event_id)) = 'rename' THEN 'rename' ELSE 'change' END AS type FROM numbered GROUP BY path, burst)"""


def _bursts(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.unix_millis("started").alias("started"), F.unix_millis("last").alias("last"), "events", "type", F.unix_millis("emitted").alias("emitted"))


@query("w05_debounce", f"WITH {BURSTS} SELECT path, started, last, events, type, last AS emitted FROM bursts")
def debounce(c: Catalog) -> DataFrame:
    return _bursts(watch.debounce(c.watch_events, "1 hour"))


@query("w06_debounce_both", f"WITH {BURSTS} SELECT path, started, last, events, type, unnest([started, last]) AS emitted FROM bursts")
def debounce_both(c: Catalog) -> DataFrame:
    return _bursts(watch.debounce(c.watch_events, "1 hour", "both"))


@query("w09_delays", "SELECT event_id, CASE WHEN path = '/u/7/0.dat' THEN 5 WHEN starts_with(path, '/u/7/') THEN 10 WHEN regexp_matches(path, '^/u/1[^/]*/[^/]*$') THEN 20 ELSE 50 END AS ms FROM watch_events")
def delays(c: Catalog) -> DataFrame:
    return c.watch_events.select("event_id", watch.delay(F.col("path"), [("/u/1*/*", 20), ("/u/7", 10), ("/u/7/0.dat", 5)], 50).alias("ms"))


@query(
    "w11_batches",
    """WITH e AS (SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000 AS "window", path, type, row_number() OVER (PARTITION BY path, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, event_id) AS k FROM watch_events),
g AS (SELECT "window", path, count(*) AS events, arg_max(type, k) AS newest, coalesce(max(k) FILTER (type = 'delete'), 0) AS d FROM e GROUP BY 1, 2),
f AS (SELECT g.*, (SELECT arg_min(type, k) FROM e WHERE e."window" = g."window" AND e.path = g.path AND k > d AND type IN ('create', 'rename')) AS sticky FROM g),
t AS (SELECT "window", path, events, CASE WHEN newest = 'delete' THEN 'delete' WHEN d > 0 AND sticky IS NOT NULL THEN sticky WHEN sticky IS NOT NULL THEN sticky ELSE 'modify' END AS type FROM f)
SELECT *, CASE type WHEN 'delete' THEN 3 WHEN 'rename' THEN 2 WHEN 'create' THEN 1 ELSE 0 END AS priority FROM t""",
)
def batches(c: Catalog) -> DataFrame:
    return watch.batch(c.watch_events, "1 day").withColumn("window", F.unix_millis("window")).withColumn("events", F.col("events").cast("long"))


@query("w13_batch_metrics", "WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS b, path, count(*) AS n FROM watch_events GROUP BY 1, 2) SELECT sum(n)::BIGINT AS received, count(*) AS emitted, count(DISTINCT b) AS batches, sum(n) / count(*) AS compression FROM w")
def batch_metrics(c: Catalog) -> DataFrame:
    return watch.batch_metrics(c.watch_events, "1 day")


@query(
    "a18_batch_latency",
    """WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS b, path, epoch_us(time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY) // 1000 - epoch_us(min(ts)) // 1000 AS ms FROM watch_events GROUP BY 1, 2)
SELECT count(*) / count(DISTINCT b) AS average_size, sum(ms) / count(*) AS average_latency_ms, count(*) / (epoch(max(b) - min(b)) + 86400) AS per_second FROM w""",
)
def batch_latency(c: Catalog) -> DataFrame:
    return watch.batch_latency(c.watch_events, "1 day")


def _turns(key: str) -> str:
    """Events numbered within a key, for the SQL that takes them in turn."""
    return f"e AS (SELECT event_id, {key} AS key, path, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS k FROM watch_events)"


@query(
    "w14_rate_limit",
    f"""WITH RECURSIVE {_turns("user_id")},
walk AS (SELECT key, event_id, k, [t] AS kept, true AS allowed FROM e WHERE k = 1
UNION ALL SELECT e.key, e.event_id, e.k, CASE WHEN ok THEN list_append(near, t) ELSE near END, ok
FROM (SELECT e.*, list_filter(kept, lambda x: x > e.t - 86400000000) AS near, len(list_filter(kept, lambda x: x > e.t - 86400000000)) < 3 AND len(list_filter(kept, lambda x: x > e.t - 3600000000)) < 2 AS ok FROM walk w JOIN e ON e.key = w.key AND e.k = w.k + 1) e)
SELECT event_id, allowed FROM walk""",
)
def rate_limit(c: Catalog) -> DataFrame:
    return watch.rate_limit(c.watch_events, most=3, per_ms=86_400_000, burst=2, burst_ms=3_600_000).select("event_id", "allowed")


@query("t10_event_priority", "SELECT event_id, CASE type WHEN 'delete' THEN 3 WHEN 'rename' THEN 2 WHEN 'create' THEN 1 ELSE 0 END AS priority FROM watch_events ORDER BY priority DESC, event_id", "t10_event_priority_all")
def event_priority_all(c: Catalog) -> DataFrame:
    return c.watch_events.select("event_id", watch.priority(F.col("type")).alias("priority")).orderBy(F.desc("priority"), "event_id")


@query(
    "w07_capped_debounce",
    f"""WITH RECURSIVE {_turns("path")},
walk AS (SELECT key, k, t AS first, t AS last, 0 AS burst FROM e WHERE k = 1
UNION ALL SELECT key, k, CASE WHEN fresh THEN t ELSE first END, t, burst + fresh::INT
FROM (SELECT e.*, first, burst, e.t - last >= 3600000000 OR e.t - first >= 7200000000 AS fresh FROM walk w JOIN e ON e.key = w.key AND e.k = w.k + 1))
SELECT key AS path, burst, count(*) AS events FROM walk GROUP BY key, burst""",
)
def capped_debounce(c: Catalog) -> DataFrame:
    rows = sequential.capped_bursts(c.watch_events, 3_600_000, 7_200_000)
    return rows.groupBy("path", "burst").agg(F.count("*").alias("events"))


@query(
    "w10_count_or_time",
    f"""WITH RECURSIVE {_turns("user_id")},
walk AS (SELECT key, event_id, k, t AS opened, [path] AS held, 0 AS batch FROM e WHERE k = 1
UNION ALL SELECT key, event_id, k, CASE WHEN fresh THEN t ELSE opened END, CASE WHEN fresh THEN [path] ELSE list_distinct(list_append(held, path)) END, batch + fresh::INT
FROM (SELECT e.*, opened, held, batch, e.t - opened >= 86400000000 OR len(held) >= 2 AS fresh FROM walk w JOIN e ON e.key = w.key AND e.k = w.k + 1))
SELECT event_id, batch FROM walk""",
)
def count_or_time(c: Catalog) -> DataFrame:
    return sequential.count_or_time_batches(c.watch_events, 86_400_000, 2).select("event_id", "batch")


@query(
    "w15_stale",
    """WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL '12 hours' AS cut FROM watch_events),
s AS (SELECT user_id, ts, sum(coalesce(cut, true)::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) AS since, epoch_us(max(ts) + INTERVAL '12 hours') AS until, count(*) AS pings FROM s GROUP BY user_id, k""",
)
def stale(c: Catalog) -> DataFrame:
    out = watch.stale(c.watch_events, "user_id", "12 hours")
    return out.select("user_id", F.unix_micros(F.col("since").cast("timestamp")).alias("since"), F.unix_micros(F.col("until").cast("timestamp")).alias("until"), "pings")
