"""Queries S, P, T: scans, predicates, find, glob, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.functions import paths, patterns, scalars
from treelake.operators import find as ops
from treelake.operators import grep as search
from treelake.operators import sparse, storage
from treelake.plans.registry import query
from treelake.sources.catalog import NOW_MS, Catalog

STAT = "path, type, size, mtime"


@query("s01_by_path", "SELECT path, type, size, blob_id FROM files WHERE path = '/docs/src1/en/1.txt'")
def by_path(c: Catalog) -> DataFrame:
    return ops.by_path(c.files, "/docs/src1/en/1.txt").select("path", "type", "size", "blob_id")


@query("s02_by_id", "SELECT id, path FROM files WHERE id IN (0, ('0x' || substr(md5('/web/3.html'), 1, 15))::BIGINT)")
def by_id(c: Catalog) -> DataFrame:
    from treelake.sources.catalog import path_id

    return c.files.where((F.col("id") == 0) | (F.col("id") == path_id(F.lit("/web/3.html")))).select("id", "path")


@query("s03_children", "SELECT id, path, name FROM files WHERE parent = '/docs/src1'")
def children(c: Catalog) -> DataFrame:
    return ops.children(c.files, "/docs/src1").select("id", "path", "name")


@query("s04_readdir", "SELECT path, name, type FROM files WHERE starts_with(path, '/docs/src2/')")
def readdir(c: Catalog) -> DataFrame:
    return ops.readdir(c.files, "/docs/src2", recursive=True)


@query("s05_readdir_sorted", "SELECT path, name, type FROM files WHERE parent = '/chat' ORDER BY path")
def readdir_sorted(c: Catalog) -> DataFrame:
    return ops.readdir(c.files, "/chat")


@query("s06_cursor_page", "SELECT path, name, type FROM files WHERE parent = '/web' ORDER BY path LIMIT 20 OFFSET 10")
def cursor_page(c: Catalog) -> DataFrame:
    return ops.page(ops.readdir(c.files, "/web"), 20, ops.encode_cursor(10))[0]


@query("s08_memory_scan", "SELECT path, size FROM files WHERE path IN ('/', '/web', '/docs')")
def memory_scan(c: Catalog) -> DataFrame:
    wanted = c.spark.createDataFrame([("/",), ("/web",), ("/docs",)], "path string")
    return c.files.join(wanted, "path").select("path", "size")


@query("s10_prefix_list", "SELECT page_key, size FROM page_metadata WHERE starts_with(page_key, '1') AND page_key > '12' ORDER BY page_key LIMIT 100")
def prefix_list(c: Catalog) -> DataFrame:
    return ops.list_prefix(c.page_metadata, "page_key", "1", 100, "12").select("page_key", "size")


@query("s11_kv_list", "SELECT c_name AS key, c_acctbal AS value FROM customer WHERE starts_with(c_name, 'Customer#0000001') ORDER BY c_name LIMIT 50")
def kv_list(c: Catalog) -> DataFrame:
    kv = c.table("customer").select(F.col("c_name").alias("key"), F.col("c_acctbal").alias("value"))
    return ops.list_prefix(kv, "key", "Customer#0000001", 50)


@query("s12_list_by_tier", "SELECT path, tier FROM files WHERE type = 'file' AND tier = 'cold' AND starts_with(path, '/docs/') ORDER BY path LIMIT 100")
def list_by_tier(c: Catalog) -> DataFrame:
    return ops.list_prefix(c.files.where("type = 'file' AND tier = 'cold'"), "path", "/docs/", 100).select("path", "tier")


@query("s14_range_read", "SELECT path, lower(hex(encode(content)[11:30])) AS data FROM regular", "s14_range_read_all")
def range_read_all(c: Catalog) -> DataFrame:
    return storage.range_read(c.contents, 10, 29).select("path", F.lower(F.hex("data")).alias("data"))


@query("s15_stream_read", "SELECT path, n AS chunk, lower(hex(encode(content)[n * 1024 + 1 : (n + 1) * 1024])) AS data FROM regular, unnest(range((strlen(content) + 1023) // 1024)) t(n)", "s15_stream_read_all")
def stream_read_all(c: Catalog) -> DataFrame:
    return storage.chunks(c.contents, 1024).select("path", F.col("chunk").cast("long").alias("chunk"), F.lower(F.hex("data")).alias("data"))


@query("s16_suffix_read", "SELECT path, lower(hex(encode(content)[greatest(strlen(content) - 15, 1):])) AS data FROM regular", "s16_suffix_read_all")
def suffix_read_all(c: Catalog) -> DataFrame:
    return storage.suffix_read(c.contents, 16).select("path", F.lower(F.hex("data")).alias("data"))


@query(
    "s17_overlay_pages",
    """WITH d AS (SELECT file_id, page_number, size * 2 AS size FROM page_metadata WHERE access_count = 3), s AS (SELECT file_id, page_number, size FROM page_metadata WHERE page_number < 2)
SELECT coalesce(s.file_id, d.file_id) AS file_id, coalesce(s.page_number, d.page_number) AS page_number, coalesce(d.size, s.size) AS size, d.size IS NOT NULL AS dirty
FROM s FULL JOIN d ON s.file_id = d.file_id AND s.page_number = d.page_number""",
)
def overlay_pages(c: Catalog) -> DataFrame:
    p = c.page_metadata
    return storage.overlay_pages(p.where("access_count = 3").select("file_id", "page_number", (F.col("size") * 2).alias("size")), p.where("page_number < 2").select("file_id", "page_number", "size"))


@query(
    "s18_extent_of_page",
    """WITH e AS (SELECT file_id, page_number // 2 AS x, min(page_number) AS a, max(page_number) - min(page_number) + 1 AS n FROM page_metadata GROUP BY 1, 2),
r AS (SELECT DISTINCT file_id, (file_id % 9)::INT AS page FROM page_metadata)
SELECT r.file_id, r.page, CASE WHEN page >= a AND page < a + n THEN x END AS extent_index FROM r LEFT JOIN e ON e.file_id = r.file_id AND e.x = r.page // 2""",
)
def extent_of_page(c: Catalog) -> DataFrame:
    p = c.page_metadata
    asked = p.select("file_id", (F.col("file_id") % 9).cast("int").alias("page")).distinct()
    return storage.extent_of_page(asked, storage.extents(p, 2), 2)


@query("s19_extent_files", "SELECT DISTINCT file_id FROM page_metadata ORDER BY file_id")
def extent_files(c: Catalog) -> DataFrame:
    return c.page_metadata.select("file_id").distinct().orderBy("file_id")


@query("s20_kv_count", "SELECT c_mktsegment AS key, count(*) AS n FROM customer GROUP BY 1")
def kv_count(c: Catalog) -> DataFrame:
    return c.table("customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.count("*").alias("n"))


#: A table of branches with times and archived ones.
BRANCH_TABLE = "SELECT concat('b', c_custkey) AS name, concat('b', c_nationkey + 1) AS parent, cast(c_custkey * 7919 % 10007 AS bigint) AS updated_at, c_mktsegment = 'BUILDING' AS is_archived FROM customer"


def branch_table(c: Catalog) -> DataFrame:
    rows = c.table("customer")
    return rows.select(F.concat(F.lit("b"), "c_custkey").alias("name"), F.concat(F.lit("b"), F.col("c_nationkey") + 1).alias("parent"), (F.col("c_custkey") * 7919 % 10007).cast("long").alias("updated_at"), (F.col("c_mktsegment") == "BUILDING").alias("is_archived"))


@query("s21_branch_list_latest", f"SELECT name, parent, updated_at FROM ({BRANCH_TABLE}) WHERE NOT is_archived AND parent = 'b3' ORDER BY updated_at DESC, name LIMIT 20 OFFSET 2")
def branch_list_latest(c: Catalog) -> DataFrame:
    from treelake.operators import branching

    return branching.listing(branch_table(c), "b3", 20, 2).select("name", "parent", "updated_at")


@query(
    "d29_branch_changes",
    f"""WITH t AS ({BRANCH_TABLE}), made AS (SELECT * FROM t UNION ALL SELECT 'new', 'b2', 20000, false),
renamed AS (SELECT CASE name WHEN 'b2' THEN 'second' ELSE name END AS name, CASE parent WHEN 'b2' THEN 'second' ELSE parent END AS parent, CASE name WHEN 'b2' THEN 20001 ELSE updated_at END AS updated_at, is_archived FROM made)
SELECT name, parent, CASE name WHEN 'b3' THEN 20002 ELSE updated_at END AS updated_at, is_archived OR name = 'b3' AS is_archived FROM renamed WHERE name <> 'new'""",
)
def branch_changes(c: Catalog) -> DataFrame:
    from treelake.operators import branching

    rows = branching.create(branch_table(c), "new", "b2", 20000)
    rows = branching.archive(branching.rename(rows, "b2", "second", 20001), "b3", 20002)
    return branching.delete(rows, "new")


@query("s21_branch_list", "SELECT name, parent FROM branches WHERE parent = 'main' ORDER BY name LIMIT 10")
def branch_list(c: Catalog) -> DataFrame:
    from treelake.operators import branching

    return branching.listing(c.branches, "main", 10)


@query("s22_history", 'SELECT "commit", file_id, modified_at FROM branch_files WHERE branch = \'dev\' ORDER BY modified_at DESC, "commit" DESC')
def history(c: Catalog) -> DataFrame:
    from treelake.operators import branching

    return branching.history(c.branch_files, "dev")


@query("s23_tenant", "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000005' OR c_nationkey = 7")
def tenant(c: Catalog) -> DataFrame:
    return c.table("customer").where("c_name = 'Customer#000000005' OR c_nationkey = 7").select("c_custkey", "c_name")


@query(
    "s24_batch_stat",
    "WITH r(path) AS (SELECT '/web/' || page_id * 2 || '.html' FROM pages) SELECT r.path, type, size, CASE WHEN f.path IS NULL THEN 'ENOENT' END AS error FROM r LEFT JOIN files f ON f.path = r.path",
)
def batch_stat(c: Catalog) -> DataFrame:
    asked = c.table("pages").select(F.concat(F.lit("/web/"), (F.col("page_id") * 2).cast("string"), F.lit(".html")).alias("path"))
    return ops.batch_stat(c.files, asked)


@query("s25_checksum", "SELECT path, sha256(content) AS checksum FROM regular")
def checksum(c: Catalog) -> DataFrame:
    return c.contents.select("path", F.sha2("content", 256).alias("checksum"))


@query("p01_find", f"SELECT {STAT} FROM files WHERE starts_with(path, '/docs/') AND name LIKE '%1.txt' AND type = 'file' AND size > 1024 AND depth <= 4 ORDER BY path")
def find(c: Catalog) -> DataFrame:
    return ops.find(c.files, ops.Find("/docs", name="*1.txt", type="f", size="+1K", maxdepth=4))


@query("p02_find_name", f"SELECT {STAT} FROM files WHERE regexp_matches(name, '^[0-9][05]\\.(txt|html)$')")
def find_name(c: Catalog) -> DataFrame:
    return ops.find(c.files, ops.Find(name="[0-9][05].{txt,html}"))


@query("p03_find_type", f"SELECT {STAT} FROM files WHERE type = 'directory'")
def find_type(c: Catalog) -> DataFrame:
    return ops.find(c.files, ops.Find(type="d"))


@query("p04_find_depth", f"SELECT {STAT} FROM files WHERE (path = '/docs' OR starts_with(path, '/docs/')) AND depth - 1 BETWEEN 1 AND 2")
def find_depth(c: Catalog) -> DataFrame:
    return ops.find(c.files, ops.Find("/docs", mindepth=1, maxdepth=2))


@query("p05_find_size", f"SELECT {STAT} FROM files WHERE size < 512")
def find_size(c: Catalog) -> DataFrame:
    return ops.find(c.files, ops.Find(size="-512B"))


@query("p06_find_mtime", f"SELECT {STAT} FROM files WHERE mtime > {{now}} - 336::BIGINT * 86400000 AND atime < {{now}} - 30::BIGINT * 86400000")
def find_mtime(c: Catalog) -> DataFrame:
    return ops.find(c.files, ops.Find(mtime="-48w", atime="+1M", now_ms=NOW_MS))


@query("p07_find_empty", f"SELECT {STAT} FROM files f WHERE NOT ((type = 'file' AND size = 0) OR (type = 'directory' AND NOT EXISTS (SELECT 1 FROM files g WHERE g.parent = f.path)))")
def find_empty(c: Catalog) -> DataFrame:
    return ops.find(c.files, ops.Find(empty=False))


@query("p08_find_prune", f"SELECT {STAT} FROM files WHERE NOT list_contains(string_split(path, '/'), 'en') AND len(list_filter(string_split(path, '/')[2:], lambda s: s LIKE 'src1%')) = 0")
def find_prune(c: Catalog) -> DataFrame:
    return ops.find(c.files, ops.Find(prune=["en", "src1*"]))


@query("p09_find_missing", f"SELECT {STAT} FROM files WHERE false")
def find_missing(c: Catalog) -> DataFrame:
    return ops.find(c.files, ops.Find("/none"))


@query("p11_glob", "SELECT DISTINCT path[2:] AS path FROM files WHERE type = 'file' AND NOT regexp_matches(path, '/\\.') AND ((starts_with(path, '/docs/') AND path LIKE '%.txt' AND NOT starts_with(path, '/docs/src1/')) OR regexp_matches(path, '^/web/[^/]*5\\.html$')) ORDER BY 1")
def glob(c: Catalog) -> DataFrame:
    return ops.glob(c.files, ["docs/**/*.txt", "web/*5.html"], ignore=["docs/src1/**"])


@query("p13_glob_stream", "SELECT path[2:] AS path FROM files WHERE type = 'file' AND NOT regexp_matches(path, '/\\.') AND starts_with(path, '/chat/') AND path LIKE '%.md'")
def glob_stream(c: Catalog) -> DataFrame:
    return ops.glob(c.files, ["chat/**/*.md"], ordered=False)


@query(
    "p10_readable",
    """WITH f AS (SELECT * REPLACE (CASE WHEN path IN ('/docs/src1', '/chat/3') OR path LIKE '/docs/src2/%' AND type = 'directory' THEN 448 ELSE mode END AS mode) FROM files),
b AS (SELECT path FROM f WHERE type = 'directory' AND uid <> 2 AND (mode & 5) <> 5)
SELECT path, type FROM f WHERE NOT EXISTS (SELECT 1 FROM b WHERE f.path = b.path OR starts_with(f.path, b.path || '/'))""",
)
def readable(c: Catalog) -> DataFrame:
    path = F.col("path")
    closed = path.isin("/docs/src1", "/chat/3") | (path.startswith("/docs/src2/") & (F.col("type") == "directory"))
    return ops.readable(c.files.withColumn("mode", F.when(closed, 448).otherwise(F.col("mode"))), 2, [9]).select("path", "type")


@query("p12_glob_dot", "SELECT DISTINCT path AS path FROM files WHERE type = 'file' AND regexp_matches(path, '^/chat/[^/]*/\\.0-[^/]*\\.md$')")
def glob_dot(c: Catalog) -> DataFrame:
    return ops.glob(c.files, ["*/.0-*.md"], cwd="/chat", absolute=True)


@query("p14_glob_match", "SELECT path FROM files WHERE regexp_matches(path, '^/docs/src[0-4]/(en|de)/[^/]*[!a-c13]\\.txt$')")
def glob_match(c: Catalog) -> DataFrame:
    return c.files.where(patterns.lower("/docs/src[0-4]/{en,de}/*[\\!a-c13].txt").column(F.col("path"))).select("path")


@query("p15_compiled_patterns", "SELECT path FROM files WHERE path LIKE '%/en/%' OR path LIKE '%.md'")
def compiled_patterns(c: Catalog) -> DataFrame:
    return c.files.where(patterns.any_of(["**/en/**", "**/*.md"], F.col("path"), dot=True) & (F.col("name") != "en")).select("path")


@query("p16_like", "SELECT path FROM files WHERE starts_with(path, '/docs/') AND name ILIKE '1_.TXT'")
def like(c: Catalog) -> DataFrame:
    return c.files.where(paths.within(F.col("path"), "/docs") & F.col("name").ilike("1_.TXT")).select("path")


@query("p17_search", "SELECT f.path, type, size, CASE WHEN content IS NULL THEN 0 ELSE (length(content) - length(replace(content, 'the', ''))) // 3 END AS count FROM (SELECT * FROM files WHERE path LIKE '/docs/%.txt' AND NOT regexp_matches(path, '/\\.') AND path NOT LIKE '%/fr/%' ORDER BY path LIMIT 50) f LEFT JOIN regular r ON r.path = f.path")
def search_files(c: Catalog) -> DataFrame:
    return search.search(c.files, c.contents, "*.txt", exclude=["fr"], limit=50, term="the")


@query("p19_list", f"SELECT path, name, type, size, mtime FROM files WHERE parent LIKE '/docs/src%' AND false OR (starts_with(path, '/docs/src4/')) ORDER BY (type <> 'directory')::INT, size DESC, path LIMIT 30 OFFSET 2")
def list_directory(c: Catalog) -> DataFrame:
    return ops.list_directory(c.files, "/docs/src4", recursive=True, sort="size", descending=True, group_directories=True, offset=2, limit=30)


@query("p20_tree", "SELECT path, name, type, depth AS level, size FROM files WHERE path <> '/' AND depth <= 3 AND NOT regexp_matches(path, '/\\.') AND NOT list_contains(string_split(path, '/'), 'es')")
def tree(c: Catalog) -> DataFrame:
    return ops.tree(c.files, max_depth=3, exclude=["es"])


@query("p21_stat", "SELECT path, id AS ino, mode | CASE WHEN type = 'file' THEN 32768 ELSE 16384 END AS mode, uid, gid, size, ((size + 511) // 512) AS blocks, 4096 AS blksize, mtime, atime FROM files")
def stat(c: Catalog) -> DataFrame:
    return ops.stat(c.files)


@query("p22_kind_of_mode", "SELECT path, CASE WHEN type = 'file' THEN 'file' ELSE 'directory' END AS kind, array_to_string(list_transform(range(9), lambda k: CASE WHEN (mode >> (8 - k)) & 1 = 1 THEN 'rwx'[k % 3 + 1] ELSE '-' END), '') AS text FROM files")
def kind_of_mode(c: Catalog) -> DataFrame:
    return c.files.select("path", scalars.kind_of_mode(scalars.full_mode(F.col("mode"), F.col("type"))).alias("kind"), scalars.mode_text(F.col("mode")).alias("text"))


@query("p23_access", "SELECT path, ((CASE WHEN uid = 2 THEN mode >> 6 WHEN gid IN (1) THEN mode >> 3 ELSE mode END) & 6) = 6 AS ok FROM files")
def access(c: Catalog) -> DataFrame:
    return c.files.select("path", scalars.access(F.col("mode"), F.col("uid"), F.col("gid"), 6, 2, [1]).alias("ok"))


@query("p24_access_root", "SELECT path, true AS ok FROM files")
def access_root(c: Catalog) -> DataFrame:
    return c.files.select("path", scalars.access(F.col("mode"), F.col("uid"), F.col("gid"), 2, 0, [0], root_bypass=True).alias("ok"))


LINKS = "SELECT '/l/' || s_suppkey AS path, CASE WHEN s_suppkey % 10 = 0 THEN '/web/' || s_suppkey || '.html' WHEN s_suppkey = 7 THEN '/l/7' ELSE '/l/' || (s_suppkey - 1) END AS target FROM supplier"


@query(
    "p25_realpath",
    f"""WITH RECURSIVE links AS ({LINKS}), walk AS (SELECT path, target, 1 AS hops FROM links UNION ALL SELECT w.path, l.target, w.hops + 1 FROM walk w JOIN links l ON l.path = w.target WHERE w.hops < 41)
SELECT path, CASE WHEN ok THEN target END AS target, CASE WHEN ok THEN hops END AS hops, CASE WHEN NOT ok THEN 'ELOOP' END AS error
FROM (SELECT path, arg_max(target, hops) AS target, max(hops) AS hops, max(hops) <= 40 AND arg_max(target, hops) NOT IN (SELECT path FROM links) AS ok FROM walk GROUP BY path)""",
)
def realpath(c: Catalog) -> DataFrame:
    k = F.col("s_suppkey")
    link = lambda x: F.concat(F.lit("/l/"), x.cast("string"))
    target = F.when(k % 10 == 0, F.concat(F.lit("/web/"), k.cast("string"), F.lit(".html"))).when(k == 7, F.lit("/l/7")).otherwise(link(k - 1))
    return ops.resolve_links(c.table("supplier").select(link(k).alias("path"), target.alias("target")))


@query("p26_sparse", "SELECT path FROM files WHERE type = 'file' AND ((starts_with(path, '/docs/') AND path NOT LIKE '%/fr/%') OR (path LIKE '/docs/%/fr/%1.txt')) AND path NOT LIKE '%/src0/%'")
def sparse_include(c: Catalog) -> DataFrame:
    return sparse.checkout(c.files, ["docs/**", "!**/fr/**", "docs/*/fr/*1.txt"], ["**/src0/**"]).select("path")


@query("p27_cone", "SELECT path FROM files WHERE path <> '/' AND (depth = 1 OR path = '/docs/src1/en' OR starts_with(path, '/docs/src1/en/') OR parent IN ('/docs', '/docs/src1'))")
def cone(c: Catalog) -> DataFrame:
    return sparse.checkout_cone(c.files, ["docs/src1/en"]).select("path")


@query("p28_gitignore", "SELECT path FROM files WHERE type = 'file' AND NOT ((path LIKE '%.html' AND NOT path LIKE '%7.html') OR path LIKE '/docs/src2/%' OR path LIKE '%/es/%')")
def gitignore(c: Catalog) -> DataFrame:
    return sparse.not_ignored(c.files, "# built\n*.html\n!*7.html\n/docs/src2/\n\nes/\n").select("path")


@query("p29_preset", "SELECT path FROM files WHERE type = 'file' AND regexp_matches(path, '\\.(html|css|js|ts|jsx|tsx)$')")
def preset(c: Catalog) -> DataFrame:
    return sparse.checkout(c.files, sparse.PRESETS["web"]).select("path")


@query("p30_filtered_walk", "SELECT path FROM files WHERE type = 'file' AND path LIKE '/chat/%' AND NOT starts_with(name, '.') AND name LIKE '%-user.md'")
def filtered_walk(c: Catalog) -> DataFrame:
    return sparse.checkout(c.files, ["chat/**"]).where(~F.col("name").startswith(".") & patterns.lower("*-user.md").column(F.col("name"))).select("path")


@query("p31_traverse", "SELECT path, depth FROM files WHERE depth <= 2 AND NOT starts_with(name, '.') AND (size > 100 OR type = 'directory')")
def traverse(c: Catalog) -> DataFrame:
    return c.files.where((F.col("depth") <= 2) & ~F.col("name").startswith(".") & ((F.col("size") > 100) | (F.col("type") == "directory"))).select("path", "depth")


@query(
    "p32_permissions",
    """WITH r AS (SELECT CASE WHEN uid < 2 THEN 'a' ELSE 'b' END AS tenant, CASE WHEN gid = 0 THEN 'write' ELSE 'read' END AS op, path FROM files)
SELECT *, (tenant = 'a' AND op IN ('read', 'write') AND starts_with(path, '/docs/')) OR (tenant = 'b' AND op = 'read' AND regexp_matches(path, '^/web/[^/]*\\.html$')) AS allowed FROM r""",
)
def permissions(c: Catalog) -> DataFrame:
    asked = c.files.select(F.when(F.col("uid") < 2, "a").otherwise("b").alias("tenant"), F.when(F.col("gid") == 0, "write").otherwise("read").alias("op"), "path")
    return ops.permitted(asked, [("a", "write", "/docs/**"), ("b", "read", "/web/*.html")])


@query("p33_traversal", "SELECT path || '/../..' AS path, depth < 2 AS escapes FROM files")
def traversal(c: Catalog) -> DataFrame:
    p = F.concat("path", F.lit("/../.."))
    return c.files.select(p.alias("path"), F.coalesce(paths.problem(p) == "TRAVERSAL", F.lit(False)).alias("escapes"))


#: Paths as requests may have them, each with the one thing that is wrong.
REQUESTS = {"EMPTY": "'  '", "NULL_BYTE": "path || '%00'", "DOT_NAME": "'..'", "EDGE_SPACE": "path || ' '", "CONTROL": "path || chr(7) || 'x'", "TRAVERSAL": "'a/./../..' || path", "TOO_LONG": "repeat('abcd', 1025)"}


@query("p33_validate", "SELECT path, k, CASE k " + " ".join(f"WHEN {k} THEN '{code}'" for k, code in enumerate(REQUESTS)) + " END AS problem FROM files, range(8) t(k)")
def validate(c: Catalog) -> DataFrame:
    asked = "CASE k " + " ".join(f"WHEN {k} THEN {made}" for k, made in enumerate(REQUESTS.values())) + " ELSE path END"
    rows = c.files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("k"))
    return rows.select("path", "k", paths.problem(F.expr(asked)).alias("problem"))


@query("t02_find_order", f"SELECT {STAT} FROM files ORDER BY path", "t02_find_order_all")
def find_order_all(c: Catalog) -> DataFrame:
    return ops.find(c.files, ops.Find()).orderBy("path")


@query("j01_file_blob", "SELECT f.path, b.ref_count FROM files f JOIN blobs b ON b.id = f.blob_id")
def file_blob(c: Catalog) -> DataFrame:
    return c.files.join(c.blobs.select("id", "ref_count").withColumnRenamed("id", "b"), F.col("blob_id") == F.col("b")).select("path", "ref_count")


@query("j02_pages_with_file", "SELECT page_key FROM page_metadata p WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = p.file_id AND o.o_orderstatus = 'O')")
def pages_with_file(c: Catalog) -> DataFrame:
    return c.page_metadata.join(c.table("orders").where("o_orderstatus = 'O'"), F.col("file_id") == F.col("o_orderkey"), "left_semi").select("page_key")


@query("j03_child_counts", "SELECT parent AS path, count(*) AS children FROM files WHERE parent IS NOT NULL GROUP BY parent")
def child_counts(c: Catalog) -> DataFrame:
    return c.files.where("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("children"))


@query(
    "f03_path_parts",
    "SELECT path, CASE WHEN path = '/' THEN '/' ELSE parent END AS dir, CASE WHEN path = '/' THEN '' ELSE name END AS base, regexp_extract(CASE WHEN path = '/' THEN '' ELSE name END, '^.+?(\\.[^.]*)$', 1) AS ext, depth FROM files",
)
def path_parts(c: Catalog) -> DataFrame:
    p = F.col("path")
    return c.files.select("path", paths.dirname(p).alias("dir"), paths.basename(p).alias("base"), paths.extname(p).alias("ext"), paths.depth(p).alias("depth"))


@query("f01_normalize", "SELECT path, CASE WHEN depth <= 1 THEN '/x' WHEN depth = 2 THEN '/' || string_split(path, '/')[2] || '/x' ELSE array_to_string(string_split(path, '/')[1:depth], '/') || '/x' END AS clean FROM files")
def normalize(c: Catalog) -> DataFrame:
    return c.files.select("path", paths.normalize_col(F.concat("path", F.lit("/.//../x/"))).alias("clean"))


@query("f08_human_size", "SELECT path, CASE WHEN size < 1024 THEN size || 'B' WHEN size < 1048576 THEN floor(size / 1024.0 + 0.5)::BIGINT || 'K' ELSE floor(size / 1048576.0 + 0.5)::BIGINT || 'M' END AS human FROM files")
def human_size(c: Catalog) -> DataFrame:
    return c.files.select("path", scalars.human_size(F.col("size")).alias("human"))


@query("f10_hash_algorithm", "SELECT path, 'sha256' AS algorithm, regexp_matches(blob_id[6:], '^[0-9a-f]{64}$') AS valid FROM files WHERE type = 'file'")
def hash_algorithm(c: Catalog) -> DataFrame:
    h = F.substring("blob_id", 6, 64)
    return c.files.where("type = 'file'").select("path", scalars.hash_algorithm(h).alias("algorithm"), h.rlike("^[0-9a-f]{64}$").alias("valid"))


@query("f11_encodings", "SELECT path, base64(encode(content)) AS b64, lower(hex(encode(content))) AS hexa FROM regular", "f11_encodings_all")
def encodings_all(c: Catalog) -> DataFrame:
    # Spark may break base64 into lines of 76 characters.
    b64 = F.translate(F.base64(F.encode("content", "UTF-8")), "\r\n", "")
    return c.contents.select("path", b64.alias("b64"), F.lower(F.hex("content")).alias("hexa"))


@query("f12_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_column(c: Catalog) -> DataFrame:
    return c.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
