"""A file catalog from tables: files, contents, blobs, pages, branches and events as DataFrames.

Content stays out of the metadata frames but for a column that Catalyst prunes
when nothing asks for it. The root has id 0; other ids come from the path, so that they
need no global numbering.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.functions import paths

EPOCH_MS, NOW_MS = 1_704_067_200_000, 1_735_689_600_000
TIER_HOT, TIER_WARM = 1024, 4096
BRANCHES = [("main", None), ("dev", "main"), ("feature", "dev"), ("hotfix", "main")]


def path_id(path: Column) -> Column:
    return F.when(path == "/", F.lit(0).cast("long")).otherwise(F.conv(F.substring(F.md5(path), 1, 15), 16, 10).cast("long"))


def tier_of(size: Column, hot: int = TIER_HOT, warm: int = TIER_WARM) -> Column:
    return F.when(size <= hot, "hot").when(size <= warm, "warm").otherwise("cold")


class Catalog:
    """Catalog of the tables below a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def regular(self) -> DataFrame:
        """(path, k, content) of every regular file."""
        s = lambda c: F.col(c).cast("string")
        docs = self.table("documents").select(F.concat(F.lit("/docs/"), "source", F.lit("/"), "lang", F.lit("/"), s("doc_id"), F.lit(".txt")).alias("path"), F.col("doc_id").alias("k"), F.col("text").alias("content"))
        pages = self.table("pages").select(F.concat(F.lit("/web/"), s("page_id"), F.lit(".html")).alias("path"), F.col("page_id").alias("k"), F.col("html").alias("content"))
        name = F.concat(F.when(F.col("turn") == 0, F.lit(".")).otherwise(F.lit("")), s("turn"), F.lit("-"), F.col("role"), F.lit(".md"))
        chat = self.table("conversations").select(F.concat(F.lit("/chat/"), s("conv_id"), F.lit("/"), name).alias("path"), (F.col("conv_id") * 100 + F.col("turn")).alias("k"), F.col("text").alias("content"))
        return docs.unionByName(pages).unionByName(chat)

    @cached_property
    def files(self) -> DataFrame:
        """All entries: regular files and their directories."""
        k = F.col("k")
        regular = self.regular.select(
            "path",
            F.lit("file").alias("type"),
            F.element_at(F.array(F.lit(420), F.lit(384), F.lit(493)), (k % 3 + 1).cast("int")).alias("mode"),
            (k % 5).cast("int").alias("uid"),
            (k % 3).cast("int").alias("gid"),
            F.octet_length("content").cast("long").alias("size"),
            F.concat(F.lit("blob-"), F.sha2("content", 256)).alias("blob_id"),
            tier_of(F.octet_length("content")).alias("tier"),
            (k * 3_600_000 + EPOCH_MS).alias("mtime"),
            (k * 3_600_000 + EPOCH_MS + (k % 7) * 86_400_000).alias("atime"),
        )
        # Paths alone are exploded and made distinct before the shuffle; each file adds a few ancestors.
        folders = self.regular.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
        folders = folders.select(
            "path",
            F.lit("directory").alias("type"),
            F.lit(493).alias("mode"),
            F.lit(0).alias("uid"),
            F.lit(0).alias("gid"),
            F.lit(0).cast("long").alias("size"),
            F.lit(None).cast("string").alias("blob_id"),
            F.lit("hot").alias("tier"),
            F.lit(EPOCH_MS).cast("long").alias("mtime"),
            F.lit(EPOCH_MS).cast("long").alias("atime"),
        )
        out = regular.unionByName(folders)
        path = F.col("path")
        return out.select(
            path_id(path).alias("id"),
            "path",
            F.when(path == "/", F.lit("/")).otherwise(paths.basename(path)).alias("name"),
            F.when(path == "/", F.lit(None)).otherwise(paths.dirname(path)).alias("parent"),
            paths.depth(path).alias("depth"),
            *out.columns[1:],
        )

    @cached_property
    def contents(self) -> DataFrame:
        return self.regular.select("path", "content")

    @cached_property
    def blobs(self) -> DataFrame:
        """One row for each distinct content, with the number of files that share it."""
        return self.files.where("type = 'file'").groupBy(F.col("blob_id").alias("id")).agg(F.max("size").alias("size"), F.count("*").alias("ref_count"), F.min("mtime").alias("created_at"), tier_of(F.max("size")).alias("tier"))

    @cached_property
    def page_metadata(self) -> DataFrame:
        from pyspark.sql import Window

        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        number = (F.row_number().over(order) - 1).alias("page_number")
        tier = F.when(F.col("l_returnflag") == "R", "hot").when(F.col("l_returnflag") == "A", "warm").otherwise("cold")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("file_id"),
            number,
            F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("page_key"),
            tier.alias("tier"),
            (F.col("l_quantity") * 4096).cast("long").alias("size"),
            (F.col("l_quantity").cast("long") % 7).alias("access_count"),
            F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("last_access_at"),
        )

    @cached_property
    def watch_events(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id"),
            F.when(kind == "signup", "create").when(kind == "error", "delete").when(kind == "purchase", "rename").otherwise("modify").alias("type"),
            F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 3).cast("string"), F.lit(".dat")).alias("path"),
            "user_id",
            F.col("ts").cast("timestamp").alias("ts"),
        )

    @cached_property
    def branches(self) -> DataFrame:
        return self.spark.createDataFrame(BRANCHES, "name string, parent string")

    @cached_property
    def branch_files(self) -> DataFrame:
        """The latest row of each (branch, file)."""
        branch = F.element_at(F.array(*(F.lit(n) for n, _ in BRANCHES)), (F.col("o_orderkey") % 4 + 1).cast("int"))
        rows = self.table("orders").select(
            branch.alias("branch"),
            F.concat(F.lit("f"), (F.col("o_orderkey") % 500).cast("string")).alias("file_id"),
            F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").cast("long").alias("size"), (F.col("o_orderstatus") == "F").alias("deleted")).alias("v"),
        )
        return rows.groupBy("branch", "file_id").agg(F.max("v").alias("v")).select("branch", "file_id", F.col("v.size").alias("size"), F.col("v.deleted").alias("deleted"), F.col("v.key").alias("commit"), F.col("v.at").alias("modified_at"))
