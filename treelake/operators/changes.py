"""Mutations as change sets: each takes the files (or key-value) frame and gives the next one.

A snapshot is written to a new folder and a pointer file swapped (sources.snapshots), so
readers see whole versions and one writer goes at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.functions import paths, scalars


class FsError(Exception):
    """A POSIX error of an argument."""

    def __init__(self, code: str, path: str) -> None:
        super().__init__(f"{code}: {path}")
        self.code, self.path = code, path


def _one(files: DataFrame, path: str):
    return files.where(F.col("path") == path).first()


def _need(files: DataFrame, path: str):
    if (row := _one(files, path)) is None:
        raise FsError("ENOENT", path)
    return row


def apply(files: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """changes: seq, op (put or delete) and the columns of files. The last change of a key wins.

    The last is a partial aggregate; base rows pass in an anti-join by key.
    """
    value = [c for c in files.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct("op", *value), "seq").alias("v"))
    kept = files.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("v.op = 'put'").select(key, *(F.col(f"v.{c}").alias(c) for c in value)))


def rename(files: DataFrame, old: str, new: str) -> DataFrame:
    """Move an entry with all below it; a move into itself is refused. Paths are compared as they are, not as patterns."""
    old, new = paths.normalize(old), paths.normalize(new)
    if new.startswith(old + "/"):
        raise FsError("EINVAL", new)
    _need(files, old)
    return move(files, old, new)


def move(files: DataFrame, old: str, new: str) -> DataFrame:
    """The rewrite of rename, without its checks."""
    moved = (F.col("path") == old) | F.col("path").startswith(old + "/")
    rest = files.where(~((F.col("path") == new) | F.col("path").startswith(new + "/")) | moved)
    path = F.when(moved, F.concat(F.lit(new), F.substring(F.col("path"), F.lit(len(old) + 1), F.length("path")))).otherwise(F.col("path"))
    return _derived(rest.withColumn("path", path))


def _derived(files: DataFrame) -> DataFrame:
    p = F.col("path")
    return files.withColumns({"name": F.when(p == "/", F.lit("/")).otherwise(paths.basename(p)), "parent": F.when(p == "/", F.lit(None)).otherwise(paths.dirname(p)), "depth": paths.depth(p)})


def copy_tree(files: DataFrame, old: str, new: str) -> DataFrame:
    """Rows of the copies; they share the blobs."""
    moved = (F.col("path") == old) | F.col("path").startswith(old + "/")
    path = F.concat(F.lit(new), F.substring(F.col("path"), F.lit(len(old) + 1), F.length("path")))
    return _derived(files.where(moved).withColumn("path", path))


def make_directories(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: (path). Paths and ancestors that aren't there yet."""
    every = wanted.select(F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("path")).distinct()
    return every.join(files.select("path"), "path", "left_anti")


def remove(files: DataFrame, path: str, recursive: bool = False, force: bool = False) -> DataFrame:
    """Without an entry (and, recursive, all below it)."""
    row = _one(files, path)
    if row is None:
        if force:
            return files
        raise FsError("ENOENT", path)
    if not recursive and row["type"] == "directory":
        if files.where(F.col("parent") == path).limit(1).count():
            raise FsError("ENOTEMPTY", path)
    return without(files, path)


def without(files: DataFrame, path: str) -> DataFrame:
    return files.where((F.col("path") != path) & ~F.col("path").startswith(path.rstrip("/") + "/"))


def unlink(files: DataFrame, wanted: DataFrame) -> DataFrame:
    return files.join(wanted.select("path"), "path", "left_anti")


def append(contents: DataFrame, more: DataFrame) -> DataFrame:
    """more: (path, data). Contents with data at the end; new paths start empty."""
    out = contents.join(more, "path", "full")
    return out.select("path", F.concat(F.coalesce("content", F.lit("")), F.coalesce("data", F.lit(""))).alias("content"))


def truncate(contents: DataFrame, length: int, extend: bool = True) -> DataFrame:
    """Bytes cut to a length, or filled with zeros to it."""
    b = F.col("content").cast("binary")
    cut = F.substring(b, 1, length)
    fill = F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(length) - F.octet_length(b), F.lit(0))))
    return contents.select("path", (F.concat(cut, fill) if extend else cut).alias("content"))


def chmod(files: DataFrame, spec: str | int, where: Column) -> DataFrame:
    return files.withColumn("mode", F.when(where, scalars.chmod(spec, F.col("mode"), F.col("type"))).otherwise(F.col("mode")))


def chown(files: DataFrame, uid: int, gid: int, where: Column) -> DataFrame:
    return files.withColumns({"uid": F.when(where, F.lit(uid)).otherwise(F.col("uid")), "gid": F.when(where, F.lit(gid)).otherwise(F.col("gid"))})


def utimes(files: DataFrame, atime: Column, mtime: Column, where: Column) -> DataFrame:
    return files.withColumns({"atime": F.when(where, scalars.utimes(atime)).otherwise(F.col("atime")), "mtime": F.when(where, scalars.utimes(mtime)).otherwise(F.col("mtime"))})


def link_counts(files: DataFrame, inode: str = "id") -> DataFrame:
    """nlink from the rows that share an inode, never stored."""
    return files.groupBy(inode).agg(F.count("*").alias("nlink"))


def partial_update(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Non-null columns of updates over base; a left join by key."""
    u = updates.select(*(F.col(c).alias(f"__{c}") for c in updates.columns))
    out = base.join(u, F.col(key) == F.col(f"__{key}"), "left")
    return out.select(*(F.coalesce(f"__{c}", c).alias(c) if c in updates.columns and c != key else F.col(c) for c in base.columns))


def upsert(base: DataFrame, rows: DataFrame, now_ms: int) -> DataFrame:
    """Key-value rows (key, value[, created_at, updated_at]) with new values; created_at stays."""
    n = rows.select("key", F.col("value").alias("__v"))
    out = base.join(n, "key", "full")
    new = F.col("__v").isNotNull()
    return out.select("key", F.coalesce("__v", "value").alias("value"), F.coalesce("created_at", F.lit(now_ms)).alias("created_at"), F.when(new, F.lit(now_ms)).otherwise(F.col("updated_at")).alias("updated_at"))


def upsert_entities(base: DataFrame, rows: DataFrame, key: str, now_ms: int) -> DataFrame:
    """Whole rows by primary key: version grows by one, updated_at is now."""
    data = [c for c in rows.columns if c != key]
    n = rows.select(key, F.struct(*data).alias("__n"))
    out = base.join(n, key, "full")
    new = F.col("__n").isNotNull()
    cols = [F.when(new, F.col(f"__n.{c}")).otherwise(F.col(c)).alias(c) for c in data]
    return out.select(key, *cols, F.when(new, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")).alias("version"), F.when(new, F.lit(now_ms)).otherwise(F.col("updated_at")).alias("updated_at"))


OPERATION_ORDER = ["mkdir", "write", "rename", "delete", "rmdir"]


def ordered(changes: DataFrame) -> DataFrame:
    """Operations in the order that a transaction applies them; stable by seq."""
    rank = F.lit(len(OPERATION_ORDER))
    for k, name in enumerate(OPERATION_ORDER):
        rank = F.when(F.col("op") == name, k).otherwise(rank)
    rank = F.when(F.col("op").isin("unlink", "rm"), OPERATION_ORDER.index("delete")).otherwise(rank)
    return changes.withColumn("rank", rank).orderBy("rank", "seq")


def batch_status(files: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (path). A status for each deletion."""
    out = requests.join(files.select("path", "type"), "path", "left")
    return out.select("path", F.when(F.col("type").isNull(), "ENOENT").when(F.col("type") == "directory", "EISDIR").otherwise("ok").alias("status"))


def _first_of(requests: DataFrame, key: str) -> DataFrame:
    """requests (with seq) and ``first``: whether a row is the first of its key."""
    least = requests.groupBy(key).agg(F.min("seq").alias("__least"))
    return requests.join(least, key, "left").withColumn("first", F.col("seq") == F.col("__least")).drop("__least")


def _with_entries(files: DataFrame, requests: DataFrame, path: str) -> DataFrame:
    """requests with the type at a path (__type) and at its directory (__above)."""
    at = files.select(F.col("path").alias("__at"), F.col("type").alias("__type"))
    above = files.select(F.col("path").alias("__dir"), F.col("type").alias("__above"))
    return requests.join(at, F.col(path) == F.col("__at"), "left").join(above, paths.dirname(F.col(path)) == F.col("__dir"), "left").drop("__at", "__dir")


def write_status(files: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (seq, path, flag, size) of normalized paths. (seq, path, status, size) of writes with flags w, wx, a and ax.

    size is the file's after the write, null where it fails. An exclusive write fails where the file is there
    or an earlier request of the batch names it; else requests of one path see the files as they were before the batch.
    """
    r = _first_of(_with_entries(files.select("path", "type"), requests, "path"), "path")
    old = files.where("type = 'file'").select(F.col("path").alias("__p"), F.col("size").alias("__size"))
    r = r.join(old, F.col("path") == F.col("__p"), "left")
    taken = (F.col("__type") == "file") | ~F.col("first")
    status = (
        F.when(F.col("flag").isNull() | ~F.col("flag").isin("w", "wx", "a", "ax"), "EINVAL")
        .when((F.col("path") == "/") | F.coalesce(F.col("__type") == "directory", F.lit(False)), "EISDIR")
        .when(F.coalesce(F.col("__above") != "directory", F.lit(True)), "ENOENT")
        .when(F.col("flag").isin("wx", "ax") & F.coalesce(taken, ~F.col("first")), "EEXIST")
        .otherwise("ok")
    )
    r = r.withColumn("status", status)
    grown = F.col("size") + F.when(F.col("flag") == "a", F.coalesce("__size", F.lit(0))).otherwise(0)
    return r.select("seq", "path", "status", F.when(F.col("status") == "ok", grown).alias("size"))


def symlinks(files: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (seq, target, path). (seq, path, target, status): a free path in a directory becomes a link, its target kept as given."""
    r = _first_of(_with_entries(files.select("path", "type"), requests, "path"), "path")
    status = (
        F.when(F.col("target").isNull() | (F.col("target") == ""), "EINVAL")
        .when(F.col("__type").isNotNull() | ~F.col("first"), "EEXIST")
        .when(F.coalesce(F.col("__above") != "directory", F.lit(True)), "ENOENT")
        .otherwise("ok")
    )
    return r.select("seq", "path", "target", status.alias("status"))


def hard_links(files: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (seq, existing, path). (seq, path, status, id, nlink): a new name of a file's inode.

    nlink counts the inode's names after the batch; it is null where the request fails.
    """
    r = _first_of(_with_entries(files.select("path", "type"), requests, "path"), "path")
    source = files.select(F.col("path").alias("__s"), F.col("type").alias("__stype"), F.col("id").alias("__id"))
    r = r.join(source, F.col("existing") == F.col("__s"), "left")
    status = (
        F.when(F.col("__stype").isNull(), "ENOENT")
        .when(F.col("__stype") == "directory", "EPERM")
        .when(F.col("__type").isNotNull() | ~F.col("first"), "EEXIST")
        .when((paths.dirname(F.col("path")) != "/") & F.col("__above").isNull(), "ENOENT")
        .otherwise("ok")
    )
    r = r.select("seq", "path", status.alias("status"), F.when(status == "ok", F.col("__id")).alias("id"))
    names = files.select("id").unionByName(r.where("status = 'ok'").select("id"))
    return r.join(link_counts(names).withColumnRenamed("id", "__n"), F.col("id") == F.col("__n"), "left").drop("__n")
