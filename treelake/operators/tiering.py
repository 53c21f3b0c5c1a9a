"""Objects of a tiered store: reads that promote, manual moves between tiers, copies and deletions.

objects: (key, tier, size, access_count, last_access_at); a key may be held by several tiers, and the
hottest answers. Requests are frames; each function gives a row of result for each request, or the next
version of the objects, for a snapshot to write. A null key is found nowhere. Keys are joined by
equality, and requests of one key are summed before they are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.operators.storage import TierConfig, priority, promoted, should_promote_object, tier_for

FIELDS = ("tier", "size", "access_count", "last_access_at")


def located(objects: DataFrame) -> DataFrame:
    """One row for each key, from the hottest tier that holds it; equal rows count once."""
    best = objects.groupBy("key").agg(F.min(F.struct(priority(F.col("tier")).alias("rank"), *FIELDS)).alias("v"))
    return best.select("key", *(F.col(f"v.{c}").alias(c) for c in FIELDS))


def read(objects: DataFrame, requests: DataFrame, now_ms: int, config: TierConfig) -> DataFrame:
    """requests: (key). (key, reads, tier, previous_tier, migrated, error) of each asked key.

    A key moves up one tier at most for a batch of reads, judged by its accesses before them.
    """
    asked = requests.groupBy("key").agg(F.count("*").alias("reads"))
    out = asked.join(located(objects), "key", "left")
    age = F.lit(now_ms) - F.col("last_access_at")
    moves = F.coalesce((F.col("tier") != "hot") & should_promote_object(F.col("access_count"), age, config), F.lit(False))
    return out.select(
        "key", "reads", F.when(moves, promoted(F.col("tier"), config)).otherwise(F.col("tier")).alias("tier"), F.when(moves, F.col("tier")).alias("previous_tier"), moves.alias("migrated"), F.when(F.col("tier").isNull(), "ENOENT").alias("error")
    )


def after_reads(objects: DataFrame, results: DataFrame, now_ms: int) -> DataFrame:
    """objects after read's results: accesses counted on the copy that answered, migrated ones in their new tier."""
    out = settle(objects, results)
    hit = results.where("error IS NULL").select("key", F.col("tier").alias("__t"), "reads")
    out = out.join(hit, "key", "left")
    is_it = F.col("tier") == F.col("__t")
    return out.select("key", "tier", "size", (F.col("access_count") + F.when(is_it, F.col("reads")).otherwise(0)).alias("access_count"), F.when(is_it, F.lit(now_ms)).otherwise(F.col("last_access_at")).alias("last_access_at"))


def _shift(objects: DataFrame, requests: DataFrame, targets: tuple[str, str], up: bool) -> DataFrame:
    out = requests.join(located(objects), "key", "left")
    known = F.col("target").isin(*targets)
    gap = priority(F.col("tier")) - priority(F.col("target"))
    moves = F.coalesce(F.col("tier").isNotNull() & known & ((gap > 0) if up else (gap < 0)), F.lit(False))
    error = F.when(~F.coalesce(known, F.lit(False)), "EINVAL").when(F.col("tier").isNull(), "ENOENT")
    return out.select("key", F.when(moves, F.col("target")).otherwise(F.col("tier")).alias("tier"), F.when(moves, F.col("tier")).alias("previous_tier"), moves.alias("migrated"), error.alias("error"))


def promote(objects: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (key, target hot or warm), a key once. An object at or above the target stays."""
    return _shift(objects, requests, ("hot", "warm"), up=True)


def demote(objects: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (key, target warm or cold), a key once. An object at or below the target stays."""
    return _shift(objects, requests, ("warm", "cold"), up=False)


def settle(objects: DataFrame, results: DataFrame) -> DataFrame:
    """objects after promote, demote or read: the copy moves to its new tier, over one that was there."""
    moved = results.where("migrated").select("key", F.col("tier").alias("__to"), F.col("previous_tier").alias("__from"))
    out = objects.join(moved, "key", "left")
    gone = F.coalesce(F.col("tier").isin(F.col("__to"), F.col("__from")), F.lit(False))
    new = located(objects).join(moved, "key").withColumn("tier", F.col("__to"))
    return out.where(~gone).select("key", *FIELDS).unionByName(new.select("key", *FIELDS))


def put(objects: DataFrame, rows: DataFrame) -> DataFrame:
    """objects with rows over those of the same key and tier."""
    return objects.join(rows.select("key", "tier"), ["key", "tier"], "left_anti").select("key", *FIELDS).unionByName(rows.select("key", *FIELDS))


def write(objects: DataFrame, rows: DataFrame, now_ms: int, config: TierConfig) -> DataFrame:
    """rows: (key, size), a key once. Each goes to the tier of its size."""
    return put(objects, rows.select("key", tier_for(F.col("size"), config).alias("tier"), "size", F.lit(0).cast("long").alias("access_count"), F.lit(now_ms).alias("last_access_at")))


def copies(objects: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """requests: (source, dest[, tier]), a dest once. Rows of the copies: in the tier asked for, else the source's."""
    asked = requests.select("source", "dest", (F.col("tier") if "tier" in requests.columns else F.lit(None).cast("string")).alias("__tier"))
    found = asked.join(located(objects), F.col("source") == F.col("key"))
    return found.select(F.col("dest").alias("key"), F.coalesce("__tier", "tier").alias("tier"), "size", F.lit(0).cast("long").alias("access_count"), F.lit(now_ms).alias("last_access_at"))


def delete(objects: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (key). objects without the copy that answers for each key; copies in colder tiers stay."""
    gone = located(objects).join(requests.select("key"), "key", "left_semi").select("key", "tier")
    return objects.join(gone, ["key", "tier"], "left_anti").select("key", *FIELDS)


def move(objects: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """requests: (source, dest), each once. objects with the sources at their new keys, in their tiers."""
    return put(delete(objects, requests.select(F.col("source").alias("key"))), copies(objects, requests.select("source", "dest"), now_ms))
