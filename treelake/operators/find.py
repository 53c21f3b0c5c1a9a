"""Metadata queries: find, glob, list, tree, stat, lookups and paging.

Each takes the files frame and returns a frame; options become one predicate, so
that Catalyst pushes what it can to the scan.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from treelake.functions import paths, patterns, scalars
from treelake.sources.snapshots import settled


@dataclass(frozen=True)
class Find:
    """Conditions that all must hold; see find."""

    path: str = "/"
    name: str | None = None
    regex: str | None = None
    type: str | None = None
    mindepth: int | None = None
    maxdepth: int | None = None
    size: str | None = None
    mtime: str | None = None
    atime: str | None = None
    ctime: str | None = None
    empty: bool | None = None
    prune: list[str] = field(default_factory=list)
    now_ms: int | None = None


def start_at(files: DataFrame, base: str) -> DataFrame:
    """The entry base and all below it."""
    return files if base == "/" else files.where((F.col("path") == base) | paths.within(F.col("path"), base))


def find(files: DataFrame, options: Find) -> DataFrame:
    """(path, type, size, mtime) by path in locale order. A missing start gives no rows.

    empty: true takes files of size 0 and directories without children; false the
    other entries. prune drops entries below the start whose name fits, with all below them.
    """
    base = paths.normalize(options.path)
    out = start_at(files, base)
    depth = F.col("depth") - paths.depth(F.lit(base))
    test = F.lit(True)
    if options.name is not None:
        test &= patterns.lower(options.name, dot=True).column(F.col("name"))
    if options.regex is not None:
        test &= F.col("name").rlike(options.regex)
    if options.type:
        test &= F.col("type") == {"f": "file", "d": "directory", "l": "symlink"}[options.type]
    if options.mindepth is not None:
        test &= depth >= options.mindepth
    if options.maxdepth is not None:
        test &= depth <= options.maxdepth
    if options.size:
        test &= scalars.size_test(F.col("size"), options.size)
    for name in ("mtime", "atime", "ctime"):
        if (text := getattr(options, name)) is not None:
            if options.now_ms is None:
                raise ValueError("now_ms is needed with a time")
            # The catalog keeps no time of status changes of its own: ctime is that of the contents.
            test &= scalars.age_test(F.col("mtime" if name == "ctime" else name), text, options.now_ms)
    for p in options.prune:
        low = patterns.lower(p, dot=True)
        below = F.when(F.col("path") == base, F.array().cast("array<string>")).otherwise(paths.segments_below(F.col("path"), base))
        test &= ~F.exists(below, low.column)
    out = out.where(test)
    if options.empty is not None:
        parents = files.where("parent IS NOT NULL").select(F.col("parent").alias("__p")).distinct()
        out = out.join(parents, F.col("path") == F.col("__p"), "left")
        bare = ((F.col("type") == "file") & (F.col("size") == 0)) | ((F.col("type") == "directory") & F.col("__p").isNull())
        out = out.where(bare if options.empty else ~bare)
    return out.select("path", "type", "size", "mtime").orderBy(paths.by_locale(F.col("path")), "path")


def glob(
    files: DataFrame,
    include: list[str],
    cwd: str = "/",
    dot: bool = False,
    ignore: list[str] | None = None,
    only_files: bool = True,
    only_directories: bool = False,
    deep: int | None = None,
    absolute: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """(path), distinct and in code order, relative to cwd unless absolute.

    Not ordered: rows as the scan finds them, without a shuffle; so it takes streams too, and a path comes as often as files hold it.

    Without dot, a path with a hidden segment is left out unless a pattern names a hidden one.
    """
    cwd = paths.normalize(cwd)
    out = files.where(paths.within(F.col("path"), cwd))
    # Literal prefixes are tested on the stored column, where the scan can use them.
    low = [patterns.lower(p, dot=dot) for p in include]
    rel = F.substring(F.col("path"), F.lit(len(cwd.rstrip("/")) + 2), F.length("path"))
    if all(x.prefix and not x.negated for x in low):
        starts = F.lit(False)
        for x in low:
            starts |= F.col("path").startswith(cwd.rstrip("/") + "/" + x.prefix)
        out = out.where(starts)
    test = F.lit(False)
    for x in low:
        test |= x.column(rel)
    out = out.where(test)
    if ignore:
        out = out.where(~patterns.any_of(ignore, rel, dot=True))
    if not dot and not any(seg.startswith(".") for p in include for seg in p.lstrip("!").split("/")):
        out = out.where(~F.exists(F.split(rel, "/"), lambda s: s.startswith(".")))
    if only_directories:
        out = out.where("type = 'directory'")
    elif only_files:
        out = out.where("type = 'file'")
    if deep is not None:
        out = out.where(F.size(F.split(rel, "/")) <= deep)
    out = out.select((F.col("path") if absolute else rel).alias("path"))
    return out.distinct().orderBy("path") if ordered else out


def by_path(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == paths.normalize(path))


def children(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("parent") == path)


def readdir(files: DataFrame, path: str, recursive: bool = False, hidden: bool = True) -> DataFrame:
    """Entries of a directory by name, or all below it by path, in locale order."""
    out = files.where(paths.within(F.col("path"), path)) if recursive else children(files, path)
    if not hidden:
        out = out.where(~F.col("name").startswith("."))
    return out.select("path", "name", "type").orderBy(paths.by_locale(F.col("path")), "path")


def encode_cursor(offset: int) -> str:
    return base64.b64encode(json.dumps({"offset": offset}).encode()).decode()


def decode_cursor(text: str | None) -> int:
    try:
        return max(0, int(json.loads(base64.b64decode(text))["offset"])) if text else 0
    except (ValueError, KeyError, TypeError):
        return 0


def page(ordered: DataFrame, limit: int, cursor: str | None = None) -> tuple[DataFrame, str]:
    """A page of an ordered frame, and the next cursor."""
    at = decode_cursor(cursor)
    return ordered.offset(at).limit(limit), encode_cursor(at + limit)


def iterate(ordered: DataFrame) -> Iterator[Row]:
    """Rows one after another, a partition at a time in the driver."""
    return ordered.toLocalIterator(prefetchPartitions=True)


def list_prefix(objects: DataFrame, key: str, prefix: str = "", limit: int = 1000, after: str | None = None) -> DataFrame:
    """Keys with a prefix in order, after a key; costs a page, not an offset."""
    out = objects.where(F.col(key).startswith(prefix)) if prefix else objects
    if after is not None:
        out = out.where(F.col(key) > after)
    return out.orderBy(key).limit(limit)


def list_directory(
    files: DataFrame,
    path: str = "/",
    recursive: bool = False,
    pattern: str | None = None,
    hidden: bool = False,
    sort: str = "name",
    descending: bool = False,
    group_directories: bool = False,
    offset: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """(path, name, type, size, mtime), sorted by name in locale order, by size or by date; ties by path."""
    out = files.where(paths.within(F.col("path"), path)) if recursive else children(files, path)
    if not hidden:
        rel = paths.segments_below(F.col("path"), path)
        out = out.where(~F.exists(rel, lambda s: s.startswith(".")))
    if pattern:
        out = out.where(patterns.lower(pattern, dot=hidden).column(F.col("name")))
    key = paths.by_locale(F.col("name")) if sort == "name" else F.col({"size": "size", "date": "mtime"}[sort])
    order = [key.desc() if descending else key, F.col("path")]
    if group_directories:
        order.insert(0, (F.col("type") != "directory").cast("int"))
    out = out.select("path", "name", "type", "size", "mtime").orderBy(*order)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def tree(files: DataFrame, path: str = "/", max_depth: int | None = None, hidden: bool = False, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, name, type, level, size): the flat form of a tree; include is for files only."""
    rel = paths.segments_below(F.col("path"), path)
    out = files.where(paths.within(F.col("path"), path)).withColumn("level", F.size(rel))
    if max_depth is not None:
        out = out.where(F.col("level") <= max_depth)
    if not hidden:
        out = out.where(~F.exists(rel, lambda s: s.startswith(".")))
    if include:
        out = out.where((F.col("type") == "directory") | patterns.any_of(include, F.col("name"), dot=True))
    for p in exclude or []:
        low = patterns.lower(p, dot=True)
        out = out.where(~F.exists(rel, low.column))
    return out.select("path", "name", "type", "level", "size").orderBy(F.transform(F.split("path", "/"), paths.by_locale))


def render_tree(flat: list[Row], root: str = "/", sizes: bool = False) -> str:
    """The drawn tree of collected rows of tree(); directories first, then by name."""
    below: dict[str, list] = {}
    for r in flat:
        parent = r["path"].rsplit("/", 1)[0] or "/"
        below.setdefault(parent, []).append(r)
    lines = [root]

    def draw(at: str, lead: str) -> None:
        rows = sorted(below.get(at, []), key=lambda r: (r["type"] != "directory", r["name"]))
        for k, r in enumerate(rows):
            last = k == len(rows) - 1
            mark = "/" if r["type"] == "directory" else f" ({r['size']}B)" if sizes else ""
            lines.append(f"{lead}{'└── ' if last else '├── '}{r['name']}{mark}")
            draw(r["path"], lead + ("    " if last else "│   "))

    draw(root, "")
    return "\n".join(lines)


def stat(files: DataFrame) -> DataFrame:
    """Stat fields of every entry given."""
    return files.select(
        "path",
        F.col("id").alias("ino"),
        scalars.full_mode(F.col("mode"), F.col("type")).alias("mode"),
        "uid",
        "gid",
        "size",
        scalars.blocks(F.col("size")).alias("blocks"),
        F.lit(4096).alias("blksize"),
        "mtime",
        "atime",
    )


def batch_stat(files: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (path). A row for each request: size and type, or an error."""
    r = requests.select(F.col("path").alias("asked"))
    out = r.join(files, F.col("asked") == F.col("path"), "left")
    return out.select(F.col("asked").alias("path"), "type", "size", F.when(F.col("path").isNull(), "ENOENT").alias("error"))


def resolve_links(links: DataFrame, most: int = 40) -> DataFrame:
    """links: (path, target). (path, target, hops, error): the end of each chain, ELOOP after ``most`` hops.

    Hops double each round (a link is replaced by its target's link), so rounds are logarithmic; each is written, as the next reads it twice.
    """
    at = links.select("path", "target", F.lit(1).alias("hops"))
    done = 1
    while done < most:
        nxt = at.select(F.col("path").alias("p"), F.col("target").alias("t"), F.col("hops").alias("h"))
        at = at.join(nxt, F.col("target") == F.col("p"), "left").select("path", F.coalesce("t", "target").alias("target"), (F.col("hops") + F.coalesce("h", F.lit(0))).alias("hops"))
        at = settled(at, "links")
        done *= 2
    ends = links.select(F.col("path").alias("e")).distinct()
    out = at.join(ends, F.col("target") == F.col("e"), "left")
    loop = F.col("e").isNotNull() | (F.col("hops") > most)
    return out.select("path", F.when(~loop, F.col("target")).alias("target"), F.when(~loop, F.col("hops")).alias("hops"), F.when(loop, "ELOOP").alias("error"))


def readable(files: DataFrame, as_uid: int, as_gids: list[int]) -> DataFrame:
    """files without the directories that the user may not read and search, and without all below them.

    Directories alone look for barred ancestors; an entry then looks at its own directory only.
    """
    folders = files.where("type = 'directory'")
    barred = folders.where(~scalars.access(F.col("mode"), F.col("uid"), F.col("gid"), 5, as_uid, as_gids, root_bypass=True)).select(F.col("path").alias("__b"))
    above = folders.select(F.col("path").alias("__c"), F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("__b"))
    closed = above.join(barred, "__b", "left_semi").select("__c").distinct()
    return files.join(closed, F.when(F.col("type") == "directory", F.col("path")).otherwise(F.col("parent")) == F.col("__c"), "left_anti")


def permitted(requests: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """requests: (tenant, op, path); rules: (tenant, grant, pattern), an argument. Adds allowed.

    admin covers all operations, write covers read.
    """
    covers = {"read": ["read"], "write": ["read", "write"], "admin": ["read", "write", "admin"]}
    test: Column = F.lit(False)
    for tenant, grant, pattern in rules:
        test |= (F.col("tenant") == tenant) & F.col("op").isin(covers[grant]) & patterns.lower(pattern, dot=True).column(F.col("path"))
    return requests.withColumn("allowed", test)


#: Content types by suffix.
CONTENT_TYPES = {
    "json": "application/json", "txt": "text/plain", "html": "text/html", "htm": "text/html", "css": "text/css", "js": "application/javascript", "mjs": "application/javascript", "ts": "text/typescript",
    "tsx": "text/typescript", "xml": "application/xml", "svg": "image/svg+xml", "md": "text/markdown", "mdx": "text/mdx", "yaml": "text/yaml", "yml": "text/yaml",
}


def content_type(path: Column) -> Column:
    """By what follows the last dot of the path; plain text else."""
    names = F.create_map(*(F.lit(x) for pair in CONTENT_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, F.lower(F.element_at(F.split(path, r"\."), -1))), F.lit("text/plain"))


def fetch(files: DataFrame, contents: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (path), each once. (resource, path, level, type, size, content_type, content, error).

    A file gives one row with its content; a directory itself at level 0 and what is up to two levels below it, hidden
    entries left out; a missing path ENOENT. An entry looks for itself and its two nearest ancestors among the requests.
    """
    near = F.concat(F.array("path"), F.slice(F.reverse(paths.ancestors(F.col("path"))), 1, 2))
    entries = files.select("path", "name", "parent", "type", "size", F.posexplode(near).alias("level", "at"))
    hidden = F.col("name").startswith(".") | ((F.col("level") == 2) & F.element_at(F.split("parent", "/"), -1).startswith("."))
    entries = entries.where((F.col("level") == 0) | ~hidden).drop("name", "parent")
    out = requests.select(F.col("path").alias("resource")).join(entries, F.col("resource") == F.col("at"), "left").drop("at")
    text = contents.join(requests.select("path"), "path", "left_semi").select(F.col("path").alias("__p"), "content")
    is_file = (F.col("type") == "file") & (F.col("level") == 0)
    out = out.join(text, is_file & (F.col("path") == F.col("__p")), "left")
    return out.select("resource", "path", "level", "type", "size", F.when(is_file, content_type(F.col("path"))).alias("content_type"), "content", F.when(F.col("path").isNull(), "ENOENT").alias("error"))


def list_page(objects: DataFrame, key: str, prefix: str = "", limit: int = 1000, after: str | None = None) -> tuple[DataFrame, str | None, bool]:
    """A page of list_prefix, the cursor of the next one and whether there is one. One row beyond the page tells."""
    rows = list_prefix(objects, key, prefix, limit + 1, after)
    ends = [r[0] for r in rows.select(key).collect()]  # a page of keys
    truncated = len(ends) > limit
    return rows.limit(limit), ends[limit - 1] if truncated and limit else None, truncated
