"""Branches as overlays: a branch's rows mask those of its ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.sources.snapshots import FEW, few, settled


def ancestry(branches: DataFrame, depth: int = 100) -> DataFrame:
    """(branch, owner, distance): each branch, itself at 0, and its ancestors.

    A table of branches, not of files: few rows pass the driver, more are written. A cycle ends at the depth.
    """
    at = branches.select(F.col("name").alias("branch"), F.col("name").alias("owner"), F.lit(0).alias("distance"))
    out, step = at, at
    up = branches.where("parent IS NOT NULL").select(F.col("name").alias("__n"), F.col("parent").alias("__p"))
    for k in range(1, depth + 1):
        step = step.join(up, F.col("owner") == F.col("__n")).select("branch", F.col("__p").alias("owner"), F.lit(k).alias("distance"))
        rows = step.limit(FEW + 1).collect()
        if not rows:
            break
        step = step.sparkSession.createDataFrame(rows, step.schema) if len(rows) <= FEW else settled(step, "ancestry")
        out = out.unionByName(step)
    return out


def resolve(files: DataFrame, branches: DataFrame) -> DataFrame:
    """(branch, file_id, owner, size, deleted) as each branch sees it, tombstones kept.

    The nearest owner wins: a partial aggregate of the least distance, no window.
    """
    rows = files.withColumnRenamed("branch", "owner").join(few(ancestry(branches)), "owner")
    best = rows.groupBy("branch", "file_id").agg(F.min(F.struct("distance", "owner", "size", "deleted", "commit")).alias("v"))
    return best.select("branch", "file_id", "v.owner", "v.size", "v.deleted", "v.commit")


def live(files: DataFrame, branches: DataFrame, branch: str | None = None) -> DataFrame:
    out = resolve(files, branches).where("NOT deleted")
    return out.where(F.col("branch") == branch) if branch else out


def sizes(files: DataFrame, branches: DataFrame) -> DataFrame:
    """(branch, file_id, size), 0 where deleted."""
    return resolve(files, branches).select("branch", "file_id", F.when(F.col("deleted"), 0).otherwise(F.col("size")).alias("size"))


def snapshot(files: DataFrame) -> DataFrame:
    """(branch, files, snapshot) of each branch's own live files; the digest is of ordered ids.

    Large branches should write their rows instead; the text of a branch goes through one task.
    """
    rows = files.where("NOT deleted").groupBy("branch").agg(F.array_sort(F.collect_list(F.struct("file_id", "size"))).alias("f"))
    return rows.select("branch", F.size("f").alias("files"), F.to_json("f").alias("snapshot"))


def dirty(files: DataFrame, branches: DataFrame) -> DataFrame:
    """(branch, file_id, kind) of a branch's own rows against its parent's view: added, changed or deleted."""
    view = resolve(files, branches).where("NOT deleted").select(F.col("branch").alias("__p"), F.col("file_id").alias("__f"))
    own = files.join(few(branches.withColumnRenamed("name", "branch")), "branch")
    out = own.join(view, (F.col("parent") == F.col("__p")) & (F.col("file_id") == F.col("__f")), "left")
    there = F.col("__f").isNotNull()
    return out.select("branch", "file_id", F.when(F.col("deleted"), "deleted").when(there, "changed").otherwise("added").alias("kind"))


def listing(branches: DataFrame, parent: str | None = None, limit: int = 100, offset: int = 0, archived: bool = False) -> DataFrame:
    """A page of branches, the latest updated first where the table has times, without archived ones unless asked for."""
    rows = branches.where(F.col("parent") == parent) if parent else branches
    if "is_archived" in branches.columns and not archived:
        rows = rows.where("NOT is_archived")
    order = [F.desc("updated_at")] if "updated_at" in branches.columns else []
    return rows.orderBy(*order, "name").offset(offset).limit(limit)


def _exists(branches: DataFrame, name: str) -> bool:
    return bool(branches.where(F.col("name") == name).limit(1).count())


def create(branches: DataFrame, name: str, parent: str | None, now: int) -> DataFrame:
    """branches (name, parent, updated_at, is_archived) with a new one; its name must be free and its parent there."""
    if _exists(branches, name):
        raise ValueError(f"branch {name} exists")
    if parent is not None and not _exists(branches, parent):
        raise ValueError(f"no branch {parent}")
    new = branches.sparkSession.createDataFrame([(name, parent, now, False)], "name string, parent string, updated_at long, is_archived boolean")
    return branches.unionByName(new)


def rename(branches: DataFrame, old: str, new: str, now: int) -> DataFrame:
    """The branch and its children's parent get the new name."""
    if not _exists(branches, old) or _exists(branches, new):
        raise ValueError(f"can't rename {old} to {new}")
    is_it = F.col("name") == old
    return branches.withColumns({"name": F.when(is_it, new).otherwise(F.col("name")), "parent": F.when(F.col("parent") == old, new).otherwise(F.col("parent")), "updated_at": F.when(is_it, now).otherwise(F.col("updated_at")).cast("long")})


def archive(branches: DataFrame, name: str, now: int, archived: bool = True) -> DataFrame:
    """The branch is archived, or taken back."""
    if not _exists(branches, name):
        raise ValueError(f"no branch {name}")
    is_it = F.col("name") == name
    return branches.withColumns({"is_archived": F.when(is_it, archived).otherwise(F.col("is_archived")), "updated_at": F.when(is_it, now).otherwise(F.col("updated_at")).cast("long")})


def delete(branches: DataFrame, name: str) -> DataFrame:
    """branches without one that no other has as parent."""
    if not _exists(branches, name):
        raise ValueError(f"no branch {name}")
    if branches.where(F.col("parent") == name).limit(1).count():
        raise ValueError(f"branch {name} has children")
    return branches.where(F.col("name") != name)


def history(files: DataFrame, branch: str) -> DataFrame:
    """Commits of a branch, the latest first."""
    return files.where(F.col("branch") == branch).select("commit", "file_id", "modified_at").orderBy(F.desc("modified_at"), F.desc("commit"))


def write(files: DataFrame, branches: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: (branch, file_id, size, deleted), each file of a branch once. Dirty rows of a copy-on-write.

    Adds was_own (the branch had a row of its own), copied_from_parent (it saw an ancestor's file) and previous (the
    commit it saw, null where it saw none). A deletion becomes a tombstone of size 0; one of a file that isn't seen is left out.
    """
    seen = resolve(files, branches).select("branch", "file_id", F.col("owner").alias("__o"), F.col("deleted").alias("__d"), F.col("commit").alias("__c"))
    out = edits.join(seen, ["branch", "file_id"], "left")
    previous = F.when(~F.col("__d"), F.col("__c"))
    own = F.coalesce(F.col("__o") == F.col("branch"), F.lit(False))
    out = out.select(
        "branch", "file_id", F.when(F.col("deleted"), 0).otherwise(F.col("size")).alias("size"), "deleted", own.alias("was_own"), F.coalesce(~own & ~F.col("__d"), F.lit(False)).alias("copied_from_parent"), previous.alias("previous")
    )
    return out.where(~F.col("deleted") | F.col("previous").isNotNull())


def discard(dirty_rows: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Dirty rows without those of keys (branch, file_id), or without any: the view falls back to what was there before."""
    return dirty_rows.where("false") if keys is None else dirty_rows.join(keys.select("branch", "file_id"), ["branch", "file_id"], "left_anti")


def commit(dirty_rows: DataFrame) -> DataFrame:
    """(branch, paths, bytes, tombstones) of what a commit of the dirty rows takes in."""
    return dirty_rows.groupBy("branch").agg(F.count("*").alias("paths"), F.sum("size").alias("bytes"), F.count_if("deleted").alias("tombstones"))


def switch(branches: DataFrame, name: str) -> str:
    """The name of the branch that is now current."""
    if not _exists(branches, name):
        raise ValueError(f"no branch {name}")
    return name


def checkout(branches: DataFrame, files: DataFrame, target: str | int) -> str:
    """switch to a branch, or to the branch of a commit."""
    if isinstance(target, str):
        return switch(branches, target)
    row = files.where(F.col("commit") == target).select("branch").first()
    if row is None:
        raise ValueError(f"no commit {target}")
    return switch(branches, row["branch"])


def drop(branches: DataFrame, files: DataFrame, name: str, current: str) -> tuple[DataFrame, DataFrame]:
    """branches and files without a branch and its rows; main and the current branch can't be dropped."""
    if name in ("main", current):
        raise ValueError(f"branch {name} can't be dropped")
    return delete(branches, name), files.where(F.col("branch") != name)
