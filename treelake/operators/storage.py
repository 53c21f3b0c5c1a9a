"""Aggregates, content addressing, tiers, pages and eviction."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelake.functions import paths
from treelake.sources.snapshots import settled

TIERS = ("hot", "warm", "cold")


def priority(tier: Column) -> Column:
    return F.when(tier == "hot", 0).when(tier == "warm", 1).otherwise(2)


# Aggregates ---------------------------------------------------------------


def tier_stats(rows: DataFrame, zero_fill: bool = True) -> DataFrame:
    """(tier, count, bytes); absent tiers as zeros or left out."""
    out = rows.groupBy("tier").agg(F.count("*").alias("count"), F.sum("size").alias("bytes"))
    if not zero_fill:
        return out
    names = rows.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    return names.join(out, "tier", "left").select("tier", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if(F.col("type") == "file").alias("files"), F.count_if(F.col("type") == "directory").alias("directories"), F.sum("size").alias("bytes"))


def directory_sizes(files: DataFrame) -> DataFrame:
    """(path, files, directories, bytes) below every directory, itself not counted.

    Each entry adds a row for each ancestor, summed before the shuffle; hot directories such as
    the root are partial sums.
    """
    rows = files.select(F.explode(paths.ancestors(F.col("path"))).alias("dir"), "type", "size")
    return rows.groupBy(F.col("dir").alias("path")).agg(F.count_if(F.col("type") == "file").alias("files"), F.count_if(F.col("type") == "directory").alias("directories"), F.sum("size").alias("bytes"))


def directory_size(files: DataFrame, path: str) -> DataFrame:
    return totals(files.where(paths.within(F.col("path"), path)))


def dedup_stats(blobs: DataFrame) -> DataFrame:
    """Both forms: saved bytes from the mean size, and exactly."""
    refs, size = F.col("ref_count"), F.col("size")
    return blobs.agg(
        F.count("*").alias("blobs"),
        F.sum("ref_count").alias("references"),
        (F.sum("ref_count") / F.count("*")).alias("ratio"),
        F.round((F.sum("ref_count") - F.count("*")) * F.avg("size")).cast("long").alias("saved_estimate"),
        F.coalesce(F.sum(F.when(refs > 1, (refs - 1) * size)), F.lit(0)).alias("saved_exact"),
    )


def recent_mean(events: DataFrame, by: str, order: list[str], value: str, n: int = 100) -> DataFrame:
    """Mean of the last n values at each event."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-(n - 1), 0)
    return events.withColumn("mean", F.avg(value).over(w))


def write_cost(rows: Column, price: float = 0.75) -> Column:
    """Of row writes, at a price for a million."""
    return rows / 1e6 * price


# Content addressing -------------------------------------------------------


def hashes(contents: DataFrame) -> DataFrame:
    c = F.col("content")
    return contents.select("path", F.sha1(c).alias("sha1"), F.sha2(c, 256).alias("sha256"), F.sha2(c, 384).alias("sha384"), F.sha2(c, 512).alias("sha512"))


def verify(contents: DataFrame, files: DataFrame) -> DataFrame:
    """(path, ok): whether content still has the blob id's hash."""
    ids = files.where("type = 'file'").select("path", "blob_id")
    return ids.join(contents.select("path", F.sha2("content", 256).alias("now")), "path", "left").select("path", F.coalesce(F.concat(F.lit("blob-"), "now") == F.col("blob_id"), F.lit(False)).alias("ok"))


def live_references(files: DataFrame) -> DataFrame:
    return files.where("blob_id IS NOT NULL").groupBy("blob_id").agg(F.count("*").alias("live"))


def resync(blobs: DataFrame, files: DataFrame) -> DataFrame:
    """blobs with ref_count set to the live references."""
    live = live_references(files).withColumnRenamed("blob_id", "__b")
    return blobs.join(live, F.col("id") == F.col("__b"), "left").withColumn("ref_count", F.coalesce("live", F.lit(0))).drop("__b", "live")


def orphans(blobs: DataFrame, files: DataFrame) -> DataFrame:
    """Blobs that no file names: an anti-join, not a stored counter."""
    return blobs.join(files.select(F.col("blob_id").alias("__b")), F.col("id") == F.col("__b"), "left_anti")


def collect_garbage(blobs: DataFrame, files: DataFrame) -> DataFrame:
    """(deleted, bytes_freed) of a dry run."""
    return orphans(blobs, files).agg(F.count("*").alias("deleted"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_freed"))


def cleanup(blobs: DataFrame, now_ms: int, batch: int = 100, grace_ms: int = 60_000, least: int = 10) -> DataFrame:
    """Orphans (ref_count 0) that a scheduled cleanup deletes: the oldest batch first, then the age test on it."""
    found = blobs.where("ref_count = 0").orderBy("created_at", "id").limit(batch)
    enough = found.agg((F.count("*") >= least).alias("enough"))
    return found.where(F.col("created_at") <= now_ms - grace_ms).crossJoin(F.broadcast(enough)).where("enough").drop("enough")  # one row


def lookup(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: (hash), any case. (hash, found, size)."""
    w = wanted.select(F.lower("hash").alias("hash"))
    return w.join(objects.select(F.col("id").alias("__i"), "size"), F.col("hash") == F.col("__i"), "left").select("hash", F.col("__i").isNotNull().alias("found"), "size")


# Tiers --------------------------------------------------------------------


@dataclass(frozen=True)
class TierConfig:
    hot_max: int = 1 << 20
    warm_max: int = 100 << 20
    warm: bool = True
    cold: bool = True
    policy: str = "on-access"
    hot_age_ms: int = 86_400_000
    warm_age_ms: int = 30 * 86_400_000
    promote_accesses: int = 1
    promote_age_ms: int = 7 * 86_400_000

    def __post_init__(self) -> None:
        if not 0 < self.hot_max <= self.warm_max:
            raise ValueError("thresholds must grow: hot, warm")
        if self.policy not in ("none", "on-access", "aggressive"):
            raise ValueError(f"policy {self.policy}")


DAY_MS = 86_400_000
#: Tier settings by name.
PRESETS = {
    "aggressive": TierConfig(hot_max=5 << 20, warm_max=200 << 20, policy="aggressive", promote_accesses=1, promote_age_ms=30 * DAY_MS, hot_age_ms=7 * DAY_MS, warm_age_ms=90 * DAY_MS),
    "balanced": TierConfig(),
    "conservative": TierConfig(hot_max=256 << 10, warm_max=50 << 20, policy="none", promote_accesses=10, promote_age_ms=1 * DAY_MS, hot_age_ms=1 * DAY_MS, warm_age_ms=7 * DAY_MS),
}


def tier_for(size: Column, c: TierConfig) -> Column:
    """The next tier stands in for a disabled one."""
    warm = F.lit("warm") if c.warm else F.lit("hot")
    cold = F.lit("cold") if c.cold else warm
    return F.when(size <= c.hot_max, "hot").when(size <= c.warm_max, warm).otherwise(cold)


def should_demote(tier: Column, age_ms: Column, c: TierConfig) -> Column:
    return ((tier == "hot") & (age_ms > c.hot_age_ms)) | ((tier == "warm") & (age_ms > c.warm_age_ms))


def demoted(tier: Column, c: TierConfig) -> Column:
    return F.when(tier == "hot", "warm" if c.warm else "cold" if c.cold else "hot").when(tier == "warm", "cold" if c.cold else "warm").otherwise(tier)


def promoted(tier: Column, c: TierConfig) -> Column:
    return F.when(tier == "cold", "warm" if c.warm else "hot").when(tier == "warm", "hot").otherwise(tier)


def should_promote(tier: Column, size: Column, accesses: Column, age_ms: Column, c: TierConfig) -> Column:
    if c.policy == "none":
        return F.lit(False)
    fits = F.when(promoted(tier, c) == "hot", size <= c.hot_max).otherwise(size <= c.warm_max)
    wanted = F.lit(True) if c.policy == "aggressive" else (accesses >= c.promote_accesses) & (age_ms <= c.promote_age_ms)
    return (tier != "hot") & fits & wanted


def should_promote_object(accesses: Column, age_ms: Column, c: TierConfig) -> Column:
    return (age_ms < c.hot_age_ms) | ((accesses > 5) & (age_ms < c.warm_age_ms))


def transition(old: Column, new: Column) -> Column:
    return F.when(priority(new) < priority(old), "promote").when(priority(new) > priority(old), "demote").otherwise("none")


def migration_plan(rows: DataFrame, now_ms: int, c: TierConfig, limit: int | None = None) -> DataFrame:
    """(page_key, tier, target) of rows to demote, oldest first."""
    age = F.lit(now_ms) - F.col("last_access_at")
    out = rows.where(should_demote(F.col("tier"), age, c)).select("page_key", "tier", demoted(F.col("tier"), c).alias("target"), "last_access_at")
    return out.orderBy("last_access_at", "page_key").limit(limit) if limit is not None else out


def frequent_reads(events: DataFrame, by: str, at_ms: str, tie: str, reads: int = 3, window_ms: int = 60_000) -> DataFrame:
    """Events at which a key has had ``reads`` within the window."""
    w = Window.partitionBy(by).orderBy(at_ms).rangeBetween(-window_ms, 0)
    return events.withColumn("recent", F.count(tie).over(w)).where(F.col("recent") >= reads)


# Pages --------------------------------------------------------------------


def oldest(pages: DataFrame, limit: int, tier: str | None = None) -> DataFrame:
    rows = pages.where(F.col("tier") == tier) if tier else pages
    return rows.orderBy("last_access_at", "page_key").limit(limit)


def eviction_candidates(pages: DataFrame, limit: int) -> DataFrame:
    """Cold before warm before hot, then least used, then oldest."""
    return pages.orderBy(priority(F.col("tier")).desc(), "access_count", "last_access_at", "page_key").limit(limit)


def hot_pages(pages: DataFrame, accesses: int, tier: str | None = None) -> DataFrame:
    rows = pages.where(F.col("access_count") >= accesses)
    return (rows.where(F.col("tier") == tier) if tier else rows).orderBy(F.desc("access_count"), "page_key")


def evict(pages: DataFrame, most: int, threshold: float = 0.9, target: float = 0.7, tier: str = "warm") -> DataFrame:
    """The oldest pages of a tier that go once it holds most * threshold of them, down to most * target.

    They grow with the table, so this is no top-k: pages are written in order over many tasks, and the counts of the
    tasks tell where the cut is.
    """
    rows = pages.where(F.col("tier") == tier)
    order = ["last_access_at", "page_key"]
    ranked = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "pages")
    # The upper bits of that id are the task, the lower 33 a row's place in it.
    counts = sorted(ranked.groupBy(F.shiftright("__at", 33).alias("task")).count().collect())
    n = sum(k for _, k in counts)
    go = n - int(most * target) if n >= int(most * threshold) else 0
    end = 0
    for task, k in counts:
        end = (task << 33) + min(go, k)
        go -= min(go, k)
        if go == 0:
            break
    return ranked.where(F.col("__at") < end).drop("__at")


def promotable(pages: DataFrame, accesses: int, capacity: int) -> DataFrame:
    """Cold pages used often enough, the most used first, as many as there is room for."""
    return pages.where((F.col("tier") == "cold") & (F.col("access_count") >= accesses)).orderBy(F.desc("access_count"), "page_key").limit(capacity)


def chunks(contents: DataFrame, size: int = 2 << 20) -> DataFrame:
    """(path, chunk, key, data) slices of fixed size; an empty content has none."""
    b = F.col("content").cast("binary")
    n = F.ceil(F.octet_length(b) / size).cast("int")
    rows = contents.where(F.octet_length("content") > 0).select("path", b.alias("b"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return rows.select("path", "chunk", F.concat(F.lit("__page__"), "path", F.lit(":"), F.col("chunk").cast("string")).alias("key"), F.substring("b", F.col("chunk") * size + 1, F.lit(size)).alias("data"))


def assemble(rows: DataFrame, by: str = "path") -> DataFrame:
    """Contents from chunks, in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "data"))), lambda x: x["data"])
    return rows.groupBy(by).agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)).alias("content"))


def range_read(contents: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Bytes from start to end, the end included."""
    b = F.col("content").cast("binary")
    return contents.select("path", F.substring(b, F.lit(start + 1), F.lit(end - start + 1) if end is not None else F.octet_length(b)).alias("data"))


def suffix_read(contents: DataFrame, n: int) -> DataFrame:
    b = F.col("content").cast("binary")
    return contents.select("path", F.substring(b, -F.least(F.lit(n), F.octet_length(b)), F.lit(n)).alias("data"))


def range_of_chunks(rows: DataFrame, offset: int, length: int, size: int) -> DataFrame:
    """A byte range from chunks: only those that it meets are read."""
    some = rows.where(F.col("chunk").between(offset // size, (offset + length - 1) // size))
    out = assemble(some)
    return out.select("path", F.substring("content", F.lit(offset % size + 1), F.lit(length)).alias("data"))


def extents(pages: DataFrame, pages_each: int = 512) -> DataFrame:
    """(file_id, extent_index, start_page, page_count, stored_size)."""
    return pages.groupBy("file_id", F.floor(F.col("page_number") / pages_each).cast("int").alias("extent_index")).agg(
        F.min("page_number").alias("start_page"), (F.max("page_number") - F.min("page_number") + 1).alias("page_count"), F.sum("size").alias("stored_size")
    )


def extent_of_page(requests: DataFrame, ext: DataFrame, pages_each: int = 512) -> DataFrame:
    """requests: (file_id, page). The owning extent, by its index: an equality join with a bound check, not a range join."""
    e = ext.select(F.col("file_id").alias("__f"), "extent_index", "start_page", "page_count")
    out = requests.join(e, (F.col("file_id") == F.col("__f")) & (F.floor(F.col("page") / pages_each) == F.col("extent_index")), "left")
    inside = (F.col("page") >= F.col("start_page")) & (F.col("page") < F.col("start_page") + F.col("page_count"))
    return out.select("file_id", "page", F.when(inside, F.col("extent_index")).alias("extent_index"))


def overlay_pages(dirty: DataFrame, stored: DataFrame) -> DataFrame:
    """Dirty pages over stored ones, by (file_id, page_number)."""
    keys = ["file_id", "page_number"]
    return stored.withColumnRenamed("size", "__old").join(dirty.withColumnRenamed("size", "__new"), keys, "full").select(*keys, F.coalesce("__new", "__old").alias("size"), F.col("__new").isNotNull().alias("dirty"))


def tiered_read(requests: DataFrame, hot: DataFrame, warm: DataFrame, cold: DataFrame, key: str) -> DataFrame:
    """Which tier answers: warm, then cold, then hot where the tier isn't known."""
    out = requests
    for name, frame in (("warm", warm), ("cold", cold), ("hot", hot)):
        out = out.join(frame.select(F.col(key).alias(f"__{name}")).distinct(), F.col(key) == F.col(f"__{name}"), "left")
    found = F.coalesce(*(F.when(F.col(f"__{n}").isNotNull(), F.lit(n)) for n in ("warm", "cold", "hot")))
    return out.select(key, found.alias("tier"))


def flush_extents(dirty: DataFrame, pages_each: int) -> DataFrame:
    """dirty: (path, chunk, data). (path, extent_index, start_page, page_count, data, checksum): pages packed in order.

    An extent has at most pages_each pages, so its list is bounded.
    """
    order = F.array_sort(F.collect_list(F.struct("chunk", "data")))
    out = dirty.groupBy("path", F.floor(F.col("chunk") / pages_each).cast("int").alias("extent_index")).agg(order.alias("p"))
    data = F.aggregate(F.transform("p", lambda x: x["data"]), F.lit(b""), lambda a, x: F.concat(a, x))
    out = out.select("path", "extent_index", F.col("p")[0]["chunk"].alias("start_page"), F.size("p").alias("page_count"), data.alias("data"))
    return out.withColumn("checksum", F.sha2("data", 256))


#: Positions of a block for each hash: all positions of a key are in one block, so that keys and blocks meet by an equality of their numbers.
SLICE_BITS = 4096


def existence_filter(rows: DataFrame, key: str, expected: int, rate: float = 0.01) -> tuple[DataFrame, int, int]:
    """A Bloom filter as blocks of SLICE_BITS positions for each hash: (bucket, bits: longs), blocks in all, hashes of a key.

    Positions m = -n ln p / (ln 2)^2, rounded up to whole blocks, hashes m / n ln 2. A key is shuffled once, as one hash; the bits
    are set where its block is, as maps with partial bitmaps would each send the whole filter.
    """
    import math

    m = max(8, math.ceil(-expected * math.log(rate) / math.log(2) ** 2))
    k = max(1, round(m / max(expected, 1) * math.log(2)))
    blocks = math.ceil(m / (k * SLICE_BITS))
    h = F.col("h")
    keys = rows.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h")).select("h", _bucket(h, blocks).alias("bucket")).repartition("bucket")
    slices = [F.substring(F.bitmap_construct_agg(_position(h, j)), 1, SLICE_BITS // 8) for j in range(k)]
    long = lambda i: F.conv(F.hex(F.substring("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    blocked = keys.groupBy("bucket").agg(F.concat(*slices).alias("bits"))
    return blocked.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(k * SLICE_BITS // 64 - 1)), long).alias("bits")), blocks, k


def _bucket(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks).cast("long"))


def _position(h: Column, j: int) -> Column:
    """Position of the j-th hash in its slice of the block."""
    return F.xxhash64(h, F.lit(j)).bitwiseAND(F.lit(SLICE_BITS - 1).cast("long"))


def may_exist(requests: DataFrame, key: str, held: tuple[DataFrame, int, int]) -> DataFrame:
    """requests with may_exist: false only for keys that were never put in, null for null keys.

    A request is shuffled once, to its key's block, and isn't sorted; a task holds its share of the blocks.
    """
    filled, blocks, k = held
    h = F.col("__h")
    asked = requests.withColumn("__h", F.when(F.col(key).isNotNull(), F.xxhash64(key)))
    filled = filled.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    found = asked.join(filled.hint("shuffle_hash"), _bucket(h, blocks) == F.col("__bucket"), "left")
    # A long holds eight bytes, the first of them highest.
    hits = [F.getbit(F.get("__bits", (F.lit(j * SLICE_BITS // 64) + F.shiftright(_position(h, j), 6)).cast("int")), _position(h, j).bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(56)).cast("int")) == 1 for j in range(k)]
    hit = F.coalesce(reduce(Column.__and__, hits), F.lit(False))
    return found.withColumn("may_exist", F.when(h.isNotNull(), hit)).drop("__h", "__bucket", "__bits")


def compression_stats(contents: DataFrame) -> DataFrame:
    """(files, original, compressed, ratio) under DEFLATE, where smaller; contents under 1 KiB are kept as they are."""
    from treelake.functions.scalars import deflate

    size = F.octet_length("content").cast("long")
    rows = contents.select(size.alias("size"), F.when(size >= 1024, F.octet_length(deflate(F.col("content").cast("binary")))).alias("small"))
    stored = F.least("size", F.coalesce("small", "size"))
    return rows.agg(F.count("*").alias("files"), F.sum("size").alias("original"), F.sum(stored).alias("compressed"), (F.sum(stored) / F.sum("size")).alias("ratio"))


def put_objects(contents: DataFrame) -> DataFrame:
    """(hash, size, data, references): framed, hashed, compressed, one row for each object."""
    from treelake.functions import scalars

    framed = scalars.framed("blob", F.col("content"))
    rows = contents.select(F.sha1(framed).alias("hash"), F.octet_length("content").alias("size"), framed.alias("framed"))
    # Counted before the bytes are compressed: each object is compressed once.
    once = rows.groupBy("hash").agg(F.count("*").alias("references"), F.first("size").alias("size"), F.first("framed").alias("framed"))
    return once.select("hash", "size", scalars.deflate("framed").alias("data"), "references")
