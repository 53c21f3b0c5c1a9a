"""Queries G, A, D, M22-M24: content search, aggregates, addressing, tiers, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.functions import scalars
from treelake.operators import grep as g
from treelake.operators import storage as st
from treelake.plans.registry import query
from treelake.sources.catalog import NOW_MS, Catalog

LINES = "lines AS (SELECT path, unnest(string_split(content, chr(10))) AS content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM regular WHERE content <> '')"
#: Scaled to the small documents of the test tables.
SMALL = st.TierConfig(hot_max=1024, warm_max=4096)
DAY = 86_400_000


@query("g01_grep", f"WITH {LINES} SELECT count(DISTINCT path) AS files, sum(len(regexp_extract_all(content, 'tion')))::BIGINT AS matches FROM lines WHERE contains(content, 'tion')")
def grep(c: Catalog) -> DataFrame:
    return g.counts(g.grep(c.contents, g.Grep("tion", literal=True)))


@query("g02_grep_lines", f"WITH {LINES} SELECT path, line, len(regexp_extract_all(content, 'th[ae]')) AS hits, min(strpos(content, 'th')) AS first FROM lines WHERE regexp_matches(content, 'th[ae]') GROUP BY path, line, content", "g02_grep_lines_all")
def grep_lines_all(c: Catalog) -> DataFrame:
    rows = g.grep(c.contents, g.Grep("th[ae]"))
    return rows.groupBy("path", "line", "content").agg(F.count("*").alias("hits"), F.min(F.instr("content", "th")).alias("first")).drop("content")


@query("g03_grep_word", f"WITH {LINES} SELECT path, line, len(regexp_extract_all(content, '(?i)\\ble\\b')) AS hits FROM lines WHERE regexp_matches(content, '(?i)\\ble\\b')")
def grep_word(c: Catalog) -> DataFrame:
    return g.grep(c.contents, g.Grep("le", literal=True, word=True, ignore_case=True)).groupBy("path", "line").agg(F.count("*").alias("hits"))


@query(
    "g04_grep_context",
    f"""WITH {LINES}, hits AS (SELECT path, line, len(regexp_extract_all(content, 'tion')) AS n FROM lines WHERE contains(content, 'tion')), ends AS (SELECT path, max(line) AS last FROM lines GROUP BY path)
SELECT h.path, h.line, least(2, h.line - 1)::INT AS before, least(1, last - h.line)::INT AS after, n AS hits FROM hits h JOIN ends ON ends.path = h.path""",
)
def grep_context(c: Catalog) -> DataFrame:
    rows = g.grep(c.contents, g.Grep("tion", literal=True, before=2, after=1))
    return rows.groupBy("path", "line", F.size("before").alias("before"), F.size("after").alias("after")).agg(F.count("*").alias("hits"))


@query("g05_grep_max", f"WITH {LINES} SELECT path, least(3, sum(len(regexp_extract_all(content, 'the'))))::BIGINT AS hits FROM lines WHERE contains(content, 'the') GROUP BY path")
def grep_max(c: Catalog) -> DataFrame:
    return g.grep(c.contents, g.Grep("the", literal=True, max_count=3)).groupBy("path").agg(F.count("*").alias("hits"))


@query("g06_grep_files", f"WITH {LINES} SELECT path, min(line) AS line FROM lines WHERE contains(content, 'ing') GROUP BY path")
def grep_files(c: Catalog) -> DataFrame:
    return g.grep(c.contents, g.Grep("ing", literal=True, files_only=True)).select("path", "line")


@query("g07_grep_invert", f"WITH {LINES} SELECT path, line, 1 AS \"column\", '' AS match FROM lines WHERE NOT contains(content, 'e')", "g07_grep_invert_all")
def grep_invert_all(c: Catalog) -> DataFrame:
    return g.grep(c.contents, g.Grep("e", literal=True, invert=True)).select("path", "line", "column", "match")


@query("g08_grep_glob", f"WITH {LINES} SELECT DISTINCT path FROM lines WHERE path LIKE '%.md' AND contains(content, 'a')")
def grep_glob(c: Catalog) -> DataFrame:
    return g.grep(c.contents, g.Grep("a", literal=True, glob="*.md", files_only=True)).select("path")


@query("g09_binary_skip", "SELECT path, NOT (length(regexp_replace(content[1:8192], '[^\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) > length(content[1:8192]) * 0.3) AS is_text FROM regular")
def binary_skip(c: Catalog) -> DataFrame:
    return c.contents.select("path", g.is_text(F.col("content")).alias("is_text"))


@query("g11_term_count", "SELECT path, (length(lower(content)) - length(replace(lower(content), 'the', ''))) // 3 AS n FROM regular")
def term_count(c: Catalog) -> DataFrame:
    return c.contents.select("path", g.term_count(F.col("content"), "The", ignore_case=True).alias("n"))


@query("p34_tool_grep", f"WITH {LINES} SELECT path, line, len(regexp_extract_all(content, 'pass')) AS hits FROM lines WHERE contains(content, 'pass')")
def tool_grep(c: Catalog) -> DataFrame:
    return g.tool_search(c.files, c.contents, "grep:pass").groupBy("path", "line").agg(F.count("*").alias("hits"))


@query("p34_tool_search", "SELECT path, type, size FROM files WHERE path LIKE '/web/%9.html'")
def tool_search(c: Catalog) -> DataFrame:
    return g.tool_search(c.files, c.contents, "*9.html")


@query("a01_tier_stats", "SELECT t.tier, count(id) AS count, coalesce(sum(size), 0)::BIGINT AS bytes FROM (VALUES ('hot'), ('warm'), ('cold')) t(tier) LEFT JOIN blobs b ON b.tier = t.tier GROUP BY t.tier")
def tier_stats(c: Catalog) -> DataFrame:
    return st.tier_stats(c.blobs)


@query("a02_tier_stats_files", "SELECT tier, count(*) AS count, sum(size)::BIGINT AS bytes FROM files GROUP BY tier")
def tier_stats_files(c: Catalog) -> DataFrame:
    return st.tier_stats(c.files, zero_fill=False)


@query("a03_tier_stats_pages", "SELECT tier, count(*) AS count, sum(size)::BIGINT AS bytes FROM page_metadata GROUP BY tier")
def tier_stats_pages(c: Catalog) -> DataFrame:
    return st.tier_stats(c.page_metadata)


@query("a05_totals", "SELECT count(*) FILTER (type = 'file') AS files, count(*) FILTER (type = 'directory') AS directories, sum(size)::BIGINT AS bytes FROM files")
def totals(c: Catalog) -> DataFrame:
    return st.totals(c.files)


@query(
    "a06_dir_size",
    """WITH up AS (SELECT unnest(list_concat(['/'], list_transform(range(2, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[1:n], '/')))) AS dir, type, size FROM files WHERE path <> '/')
SELECT dir AS path, count(*) FILTER (type = 'file') AS files, count(*) FILTER (type = 'directory') AS directories, sum(size)::BIGINT AS bytes FROM up GROUP BY dir""",
)
def dir_size(c: Catalog) -> DataFrame:
    return st.directory_sizes(c.files)


@query("a06_dir_size_one", "SELECT count(*) FILTER (type = 'file') AS files, count(*) FILTER (type = 'directory') AS directories, sum(size)::BIGINT AS bytes FROM files WHERE starts_with(path, '/docs/')")
def dir_size_one(c: Catalog) -> DataFrame:
    return st.directory_size(c.files, "/docs")


@query("a07_dedup_stats", "SELECT count(*) AS blobs, sum(ref_count)::BIGINT AS \"references\", sum(ref_count) / count(*) AS ratio, round((sum(ref_count) - count(*)) * avg(size))::BIGINT AS saved_estimate, coalesce(sum((ref_count - 1) * size) FILTER (ref_count > 1), 0)::BIGINT AS saved_exact FROM blobs")
def dedup_stats(c: Catalog) -> DataFrame:
    return st.dedup_stats(c.blobs)


@query("a09_ref_count", "SELECT id, ref_count FROM blobs WHERE ref_count > 1")
def ref_count(c: Catalog) -> DataFrame:
    return c.blobs.where("ref_count > 1").select("id", "ref_count")


@query("a10_live_references", "SELECT blob_id, count(*) AS live FROM files WHERE blob_id IS NOT NULL GROUP BY blob_id")
def live_references(c: Catalog) -> DataFrame:
    return st.live_references(c.files)


@query("a11_resync", "SELECT b.id, coalesce(n, 0) AS ref_count FROM blobs b LEFT JOIN (SELECT blob_id, count(*) AS n FROM files WHERE starts_with(path, '/docs/') GROUP BY blob_id) l ON l.blob_id = b.id")
def resync(c: Catalog) -> DataFrame:
    return st.resync(c.blobs, c.files.where("path LIKE '/docs/%'")).select("id", "ref_count")


@query("a12_orphans", "SELECT id, size FROM blobs WHERE id NOT IN (SELECT blob_id FROM files WHERE blob_id IS NOT NULL AND NOT starts_with(path, '/web/'))")
def orphans(c: Catalog) -> DataFrame:
    return st.orphans(c.blobs, c.files.where("path NOT LIKE '/web/%'")).select("id", "size")


@query("a13_extents", "SELECT file_id, page_number // 2 AS extent_index, min(page_number) AS start_page, max(page_number) - min(page_number) + 1 AS page_count, sum(size)::BIGINT AS stored_size FROM page_metadata GROUP BY 1, 2")
def extents(c: Catalog) -> DataFrame:
    return st.extents(c.page_metadata, 2)


@query("a14_file_sizes", "SELECT file_id, coalesce(sum(size), 0)::BIGINT AS size FROM page_metadata GROUP BY file_id")
def file_sizes(c: Catalog) -> DataFrame:
    return c.page_metadata.groupBy("file_id").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


@query("a15_hot_pages", "SELECT page_key, access_count FROM page_metadata WHERE access_count >= 6 AND tier = 'warm' ORDER BY access_count DESC, page_key")
def hot_pages(c: Catalog) -> DataFrame:
    return st.hot_pages(c.page_metadata, 6, "warm").select("page_key", "access_count")


@query("a16_dirty_files", "SELECT DISTINCT file_id FROM page_metadata WHERE access_count = 0")
def dirty_files(c: Catalog) -> DataFrame:
    return c.page_metadata.where("access_count = 0").select("file_id").distinct()


@query("a19_recent_mean", "SELECT event_id, avg(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 99 PRECEDING) AS mean FROM events")
def recent_mean(c: Catalog) -> DataFrame:
    # Whole hundredths, so that sums are exact in any order.
    cents = c.table("events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return st.recent_mean(cents, "user_id", ["ts", "event_id"], "cents").select("event_id", "mean")


@query("a20_write_cost", "SELECT count(*) AS rows, round(count(*) / 1e6 * 0.75, 9) AS cost FROM page_metadata")
def write_cost(c: Catalog) -> DataFrame:
    return c.page_metadata.agg(F.count("*").alias("rows"), F.round(st.write_cost(F.count("*")), 9).alias("cost"))


@query("d01_tier_two", "SELECT path, CASE WHEN size <= 2048 THEN 'hot' ELSE 'warm' END AS target FROM files")
def tier_two(c: Catalog) -> DataFrame:
    return c.files.select("path", st.tier_for(F.col("size"), st.TierConfig(2048, 2048, cold=False)).alias("target"))


@query("d02_tier_three", "SELECT path, CASE WHEN size <= 1024 THEN 'hot' WHEN size <= 4096 THEN 'warm' ELSE 'cold' END AS target FROM files")
def tier_three(c: Catalog) -> DataFrame:
    return c.files.select("path", st.tier_for(F.col("size"), SMALL).alias("target"))


@query("d03_promote", f"SELECT page_key, tier <> 'hot' AND size <= 4096 * 40 AND access_count >= 1 AND {{now}} - last_access_at <= 9000::BIGINT * {DAY} AS promote FROM page_metadata")
def promote(c: Catalog) -> DataFrame:
    cfg = st.TierConfig(hot_max=4096 * 40, warm_max=4096 * 40, promote_age_ms=9000 * DAY)
    return c.page_metadata.select("page_key", st.should_promote(F.col("tier"), F.col("size"), F.col("access_count"), F.lit(NOW_MS) - F.col("last_access_at"), cfg).alias("promote"))


@query("d04_demote", f"SELECT page_key, CASE tier WHEN 'hot' THEN {{now}} - last_access_at > {DAY} WHEN 'warm' THEN {{now}} - last_access_at > 30::BIGINT * {DAY} ELSE false END AS demote FROM page_metadata")
def demote(c: Catalog) -> DataFrame:
    return c.page_metadata.select("page_key", st.should_demote(F.col("tier"), F.lit(NOW_MS) - F.col("last_access_at"), st.TierConfig()).alias("demote"))


@query("d05_targets", "SELECT page_key, CASE tier WHEN 'cold' THEN 'warm' ELSE 'hot' END AS up, CASE tier WHEN 'hot' THEN 'warm' ELSE 'cold' END AS down FROM page_metadata")
def targets(c: Catalog) -> DataFrame:
    return c.page_metadata.select("page_key", st.promoted(F.col("tier"), st.TierConfig()).alias("up"), st.demoted(F.col("tier"), st.TierConfig()).alias("down"))


@query("d07_promote_object", f"SELECT page_key, ({{now}} - last_access_at < {DAY}) OR (access_count > 5 AND {{now}} - last_access_at < 30::BIGINT * {DAY}) AS promote FROM page_metadata")
def promote_object(c: Catalog) -> DataFrame:
    return c.page_metadata.select("page_key", st.should_promote_object(F.col("access_count"), F.lit(NOW_MS) - F.col("last_access_at"), st.TierConfig()).alias("promote"))


@query("d08_migration", f"SELECT page_key, tier, CASE tier WHEN 'hot' THEN 'warm' ELSE 'cold' END AS target, last_access_at FROM page_metadata WHERE (tier = 'hot' AND {{now}} - last_access_at > {DAY}) OR (tier = 'warm' AND {{now}} - last_access_at > 30::BIGINT * {DAY}) ORDER BY last_access_at, page_key LIMIT 100")
def migration(c: Catalog) -> DataFrame:
    return st.migration_plan(c.page_metadata, NOW_MS, st.TierConfig(), 100)


@query("d09_frequent_reads", "SELECT event_id, recent FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS recent FROM events) WHERE recent >= 2")
def frequent_reads(c: Catalog) -> DataFrame:
    e = c.watch_events.withColumn("ms", F.unix_millis("ts"))
    return st.frequent_reads(e, "user_id", "ms", "event_id", 2, 3_600_000).select("event_id", "recent")


@query("d10_promotable", "SELECT page_key, access_count FROM page_metadata WHERE tier = 'cold' AND access_count >= 3 ORDER BY access_count DESC, page_key LIMIT 50")
def promotable(c: Catalog) -> DataFrame:
    return st.promotable(c.page_metadata, 3, 50).select("page_key", "access_count")


@query("d11_transition", "SELECT page_key, CASE WHEN tier = 'hot' THEN CASE WHEN access_count > 3 THEN 'none' ELSE 'demote' END WHEN access_count > 3 THEN 'promote' WHEN tier = 'warm' THEN 'demote' ELSE 'none' END AS change FROM page_metadata")
def transition(c: Catalog) -> DataFrame:
    return c.page_metadata.select("page_key", st.transition(F.col("tier"), F.when(F.col("access_count") > 3, "hot").otherwise("cold")).alias("change"))


@query("d12_hashes", "SELECT path, sha1(content) AS sha1, sha256(content) AS sha256 FROM regular")
def hashes(c: Catalog) -> DataFrame:
    return st.hashes(c.contents).select("path", "sha1", "sha256")


@query("d13_blob_store", "SELECT id, size, ref_count, created_at, tier FROM blobs")
def blob_store(c: Catalog) -> DataFrame:
    return c.blobs


@query("d14_release", "SELECT blob_id AS id, count(*) AS ref_count FROM files WHERE type = 'file' AND NOT starts_with(path, '/docs/src1/') GROUP BY blob_id")
def release(c: Catalog) -> DataFrame:
    return st.live_references(c.files.where("path NOT LIKE '/docs/src1/%'")).select(F.col("blob_id").alias("id"), F.col("live").alias("ref_count"))


@query("d15_verify", "SELECT path, strlen(content) % 7 <> 3 AS ok FROM regular")
def verify(c: Catalog) -> DataFrame:
    """One in seven contents is damaged before."""
    damaged = F.when(F.octet_length("content") % 7 == 3, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    return st.verify(c.contents.withColumn("content", damaged), c.files)


@query("d16_object_hash", "SELECT path, sha1(encode('blob ' || strlen(content)) || '\\x00'::BLOB || encode(content)) AS hash FROM regular", "d16_object_hash_all")
def object_hash_all(c: Catalog) -> DataFrame:
    return c.contents.select("path", scalars.object_hash("blob", F.col("content")).alias("hash"))


@query("d17_object_path", "SELECT path, 'objects/' || blob_id[6:7] || '/' || blob_id[8:] AS object FROM files WHERE type = 'file'")
def object_path(c: Catalog) -> DataFrame:
    h = F.substring("blob_id", 6, 64)
    return c.files.where("type = 'file'").select("path", scalars.object_path(h).alias("object"))


@query("d19_lookup", "WITH w AS (SELECT 'blob-' || sha256('/web/' || page_id) AS hash FROM pages UNION ALL SELECT id FROM blobs WHERE ref_count > 1) SELECT hash, b.id IS NOT NULL AS found, size FROM w LEFT JOIN blobs b ON b.id = w.hash")
def lookup(c: Catalog) -> DataFrame:
    none = c.table("pages").select(F.concat(F.lit("blob-"), F.sha2(F.concat(F.lit("/web/"), F.col("page_id").cast("string")), 256)).alias("hash"))
    return st.lookup(c.blobs, none.unionByName(c.blobs.where("ref_count > 1").select(F.upper("id").alias("hash"))))


@query("d21_garbage", "SELECT count(*) AS deleted, coalesce(sum(size), 0)::BIGINT AS bytes_freed FROM blobs WHERE id NOT IN (SELECT blob_id FROM files WHERE blob_id IS NOT NULL AND starts_with(path, '/docs/'))")
def garbage(c: Catalog) -> DataFrame:
    return st.collect_garbage(c.blobs, c.files.where("path LIKE '/docs/%'"))


@query("d22_cleanup", "SELECT id, created_at FROM (SELECT id, created_at FROM blobs WHERE ref_count = 1 ORDER BY created_at, id LIMIT 100) WHERE created_at <= 1704067200000 + 40 * 3600000 - 60000")
def cleanup(c: Catalog) -> DataFrame:
    zero = c.blobs.where("ref_count = 1").withColumn("ref_count", F.lit(0))
    return st.cleanup(zero, 1_704_067_200_000 + 40 * 3_600_000).select("id", "created_at")


@query("d30_tier_by_blob", "SELECT f.path, CASE WHEN b.ref_count > 1 THEN 'warm' ELSE f.tier END AS tier FROM files f JOIN blobs b ON b.id = f.blob_id")
def tier_by_blob(c: Catalog) -> DataFrame:
    moved = c.blobs.where("ref_count > 1").select(F.col("id").alias("b"), F.lit("warm").alias("t"))
    return c.files.where("type = 'file'").join(moved, F.col("blob_id") == F.col("b"), "left").select("path", F.coalesce("t", "tier").alias("tier"))


@query("d31_tiered_read", "SELECT page_key, CASE WHEN access_count = 0 THEN NULL ELSE tier END AS tier FROM page_metadata")
def tiered_read(c: Catalog) -> DataFrame:
    p = c.page_metadata
    at = lambda t: p.where((F.col("tier") == t) & (F.col("access_count") > 0))
    return st.tiered_read(p.select("page_key"), at("hot"), at("warm"), at("cold"), "page_key")


@query("d34_pages_of_file", "SELECT file_id, page_number, page_key FROM page_metadata WHERE file_id IN (1, 7, 33) ORDER BY file_id, page_number")
def pages_of_file(c: Catalog) -> DataFrame:
    return c.page_metadata.where("file_id IN (1, 7, 33)").select("file_id", "page_number", "page_key").orderBy("file_id", "page_number")


@query("d35_chunk_range", "SELECT path, lower(hex(encode(content)[701:1000])) AS data FROM regular WHERE strlen(content) > 512", "d35_chunk_range_all")
def chunk_range_all(c: Catalog) -> DataFrame:
    return st.range_of_chunks(st.chunks(c.contents, 512), 700, 300, 512).select("path", F.lower(F.hex("data")).alias("data"))


@query("t04_oldest", "SELECT page_key, last_access_at FROM page_metadata WHERE tier = 'warm' ORDER BY last_access_at, page_key LIMIT 25")
def oldest(c: Catalog) -> DataFrame:
    return st.oldest(c.page_metadata, 25, "warm").select("page_key", "last_access_at")


@query("t05_eviction", "SELECT page_key, tier, access_count FROM page_metadata ORDER BY CASE tier WHEN 'hot' THEN 0 WHEN 'warm' THEN 1 ELSE 2 END DESC, access_count, last_access_at, page_key LIMIT 50")
def eviction(c: Catalog) -> DataFrame:
    return st.eviction_candidates(c.page_metadata, 50).select("page_key", "tier", "access_count")


@query("t07_lru", "SELECT page_key FROM page_metadata WHERE tier = 'warm' ORDER BY last_access_at, page_key LIMIT (SELECT CASE WHEN count(*) >= 900 THEN count(*) - 700 ELSE 0 END FROM page_metadata WHERE tier = 'warm')")
def lru(c: Catalog) -> DataFrame:
    return st.evict(c.page_metadata, 1000).select("page_key")


@query("t09_migration_batch", "SELECT page_key FROM page_metadata WHERE tier = 'hot' AND last_access_at < 900000000000 ORDER BY last_access_at, page_key LIMIT 40")
def migration_batch(c: Catalog) -> DataFrame:
    return st.oldest(c.page_metadata.where("last_access_at < 900000000000"), 40, "hot").select("page_key")


@query("m23_chunks", "SELECT path, n AS chunk, '__page__' || path || ':' || n AS key, strlen(content) AS total FROM regular, unnest(range((strlen(content) + 511) // 512)) t(n)", "m23_chunks_all")
def chunks_all(c: Catalog) -> DataFrame:
    rows = st.chunks(c.contents, 512)
    return rows.join(c.contents.select("path", F.octet_length("content").cast("long").alias("total")), "path").select("path", F.col("chunk").cast("long").alias("chunk"), "key", "total")


@query("m24_chunk_store", "SELECT path, sha256(content) AS sha256 FROM regular WHERE content <> ''", "m24_chunk_store_all")
def chunk_store_all(c: Catalog) -> DataFrame:
    return st.assemble(st.chunks(c.contents, 512)).select("path", F.sha2("content", 256).alias("sha256"))


@query("m22_flush_extents", "SELECT path, e AS extent_index, e * 4 AS start_page, least(4, (strlen(content) + 255) // 256 - e * 4) AS page_count, sha256(encode(content)[e * 1024 + 1 : (e + 1) * 1024]) AS checksum FROM regular, unnest(range((strlen(content) + 1023) // 1024)) t(e)", "m22_flush_extents_all")
def flush_extents_all(c: Catalog) -> DataFrame:
    return st.flush_extents(st.chunks(c.contents, 256), 4).drop("data")


@query("a21_existence", "SELECT count(*) FILTER (access_count > 3) AS members, 0::BIGINT AS missed, count(*) FILTER (access_count <= 3) AS others, true AS few_false FROM page_metadata")
def existence(c: Catalog) -> DataFrame:
    """All keys asked of a filter that holds those read more than three times: none of these is missed, and few others pass."""
    pages = c.page_metadata.select("page_key", F.col("access_count").alias("n"))
    held = st.existence_filter(pages.where("n > 3"), "page_key", max(100_000, pages.where("n > 3").count()))
    asked = st.may_exist(pages, "page_key", held)
    members, others = F.count_if(F.col("n") > 3), F.count_if(F.col("n") <= 3)
    false = F.count_if((F.col("n") <= 3) & F.col("may_exist"))
    return asked.agg(members.alias("members"), F.count_if((F.col("n") > 3) & ~F.col("may_exist")).alias("missed"), others.alias("others"), (false <= 0.03 * others).alias("few_false"))


@query("a17_compression")
def compression(c: Catalog) -> DataFrame:
    return st.compression_stats(c.contents)


@query("d18_put_objects", 'SELECT sha1(encode(\'blob \' || strlen(content)) || \'\\x00\'::BLOB || encode(content)) AS hash, strlen(content) AS size, count(*) AS "references" FROM regular GROUP BY 1, 2')
def put_objects(c: Catalog) -> DataFrame:
    return st.put_objects(c.contents).drop("data")


#: 64-bit FNV-1a as a fold over bytes; a hugeint holds the product.
def _fnv(data: str) -> str:
    folded = f"list_reduce(list_transform(range(1, octet_length({data}) + 1), lambda i: ('0x' || hex({data}[i:i]))::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT)"
    return f"lpad(lower(to_hex(CASE WHEN octet_length({data}) = 0 THEN 14695981039346656037::HUGEINT ELSE {folded} END)), 16, '0')"


@query("f13_fnv", f"WITH b AS (SELECT path, encode(content) AS data FROM regular) SELECT path, {_fnv('data')} AS fnv FROM b")
def fnv(c: Catalog) -> DataFrame:
    return c.contents.select("path", scalars.fnv1a64(F.col("content").cast("binary")).alias("fnv"))


@query("f16_codec", "SELECT path, ['none', 'gzip', 'lz4', 'zstd', 'zlib', 'none'][1 + strlen(content) % 6] AS codec FROM regular")
def codec(c: Catalog) -> DataFrame:
    """The first bytes of each format, or of none, before the contents."""
    first = F.element_at(F.array(*[F.unhex(F.lit(x)) for x in ("00", "1F8B0800", "04224D18", "28B52FFD", "789C", "1F8C")]), (1 + F.octet_length("content") % 6).cast("int"))
    return c.contents.select("path", scalars.codec(F.concat(first, F.col("content").cast("binary"))).alias("codec"))


@query("f20_snake_case", "SELECT p_partkey, ltrim(lower(regexp_replace(p_name, '([A-Z])', '_\\1', 'g')), '_') AS name, ltrim(lower(regexp_replace(p_type, '([A-Z])', '_\\1', 'g')), '_') AS kind FROM part")
def snake_case(c: Catalog) -> DataFrame:
    return c.table("part").select("p_partkey", scalars.snake_case_col(F.col("p_name")).alias("name"), scalars.snake_case_col(F.col("p_type")).alias("kind"))


@query("f20_identity", "SELECT path, mode | 32768 AS mode FROM files WHERE type = 'file' AND uid = 3")
def identity(c: Catalog) -> DataFrame:
    return c.files.where("type = 'file' AND uid = 3").select("path", scalars.full_mode(F.col("mode"), F.col("type")).alias("mode"))
