"""Path functions. The Python forms are for arguments, the Column forms for data; both agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: str) -> str:
    """Resolve ``.``, ``..`` and repeated slashes; a trailing slash goes; an empty path is ``.``."""
    absolute, out = path.startswith("/"), []
    for part in path.split("/"):
        if part in ("", "."):
            continue
        if part == "..":
            if out and out[-1] != "..":
                out.pop()
            elif not absolute:
                out.append(part)
            continue
        out.append(part)
    text = "/".join(out)
    return "/" + text if absolute else text or "."


def join(*parts: str) -> str:
    return normalize("/".join(p for p in parts if p)) if any(parts) else "."


def resolve(*parts: str, cwd: str = "/") -> str:
    """The last absolute part and what follows it, below cwd if there is none."""
    out = cwd
    for p in parts:
        out = p if p.startswith("/") else f"{out}/{p}"
    return normalize(out)


def relative(a: str, b: str) -> str:
    """The way from directory a to b."""
    x, y = (normalize(p).strip("/").split("/") if normalize(p).strip("/") else [] for p in (a, b))
    same = 0
    while same < min(len(x), len(y)) and x[same] == y[same]:
        same += 1
    return "/".join([".."] * (len(x) - same) + y[same:])


def has_traversal(path: str) -> bool:
    return ".." in path.split("/")


def is_within(path: str, base: str) -> bool:
    path, base = normalize(path), normalize(base)
    return path == base or path.startswith(base.rstrip("/") + "/")


def validate(path: str, longest: int = 4096) -> str | None:
    """What is wrong with a path argument, or null."""
    if not path or not path.strip():
        return "EMPTY"
    if len(path) > longest:
        return "TOO_LONG"
    lower = path.lower()
    if "\0" in path or "%00" in lower or "\\0" in lower or "\\x00" in lower:
        return "NULL_BYTE"
    if path in (".", ".."):
        return "DOT_NAME"
    if path != path.strip():
        return "EDGE_SPACE"
    if any(ord(c) < 32 or ord(c) == 127 for c in path):
        return "CONTROL"
    depth = 0
    for part in path.split("/"):
        depth += -1 if part == ".." else part not in ("", ".")
        if depth < 0:
            return "TRAVERSAL"
    return None


def problem(path: Column, longest: int = 4096) -> Column:
    """What ``validate`` says of each path: a code, or null. A null path is empty."""
    lower, parts = F.lower(path), F.split(path, "/")
    # The depth after each part, and the least of them, in one pass.
    step = lambda p: F.when(p == "..", -1).when((p == "") | (p == "."), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    walk = lambda s, p: F.struct((s["depth"] + step(p)).alias("depth"), F.least(s["least"], s["depth"] + step(p)).alias("least"))
    null_byte = path.contains("\0") | lower.contains("%00") | lower.contains("\\0") | lower.contains("\\x00")
    return (
        F.when(path.isNull() | ~path.rlike(r"(?U)\S"), "EMPTY")
        .when(F.length(path) > longest, "TOO_LONG")
        .when(null_byte, "NULL_BYTE")
        .when(path.isin(".", ".."), "DOT_NAME")
        .when(path.rlike(r"(?U)^\s|\s\z"), "EDGE_SPACE")
        .when(path.rlike(r"[\x00-\x1F\x7F]"), "CONTROL")
        .when(F.aggregate(parts, start, walk, lambda s: s["least"]) < 0, "TRAVERSAL")
    )


def normalize_col(path: Column) -> Column:
    """normalize of an absolute path."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def dirname(path: Column) -> Column:
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(path == "/", "/").when(~path.contains("/"), ".").when(cut == "", "/").otherwise(cut)


def basename(path: Column, suffix: str = "") -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    if not suffix:
        return name
    return F.when(name.endswith(suffix) & (name != suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def extname(path: Column) -> Column:
    """From the last dot of the name, not counting one at its start."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def parse(path: Column) -> Column:
    name, ext = basename(path), extname(path)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.struct(F.when(path.startswith("/"), "/").otherwise("").alias("root"), dirname(path).alias("dir"), name.alias("base"), ext.alias("ext"), stem.alias("name"))


def is_absolute(path: Column) -> Column:
    return path.startswith("/")


def depth(path: Column) -> Column:
    """Segments below the root, which has depth 0."""
    return F.when(path == "/", 0).otherwise(F.size(F.split(path, "/")) - 1)


def ancestors(path: Column) -> Column:
    """Proper ancestors of an absolute path, the root first."""
    parts = F.split(path, "/")
    below = F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
    return F.when(path == "/", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("/")), below))


def by_locale(text: Column) -> Column:
    """A sort key in the order of the root locale: punctuation, digits, letters, a small one before its capital."""
    return F.collate(text, "UNICODE")


def within(path: Column, base: str) -> Column:
    """Strictly below base; a prefix test, so that Parquet's statistics can skip row groups."""
    return (path != "/") if base == "/" else path.startswith(base.rstrip("/") + "/")


def segments_below(path: Column, base: str) -> Column:
    """Segments of a path after base."""
    return F.split(F.substring(path, F.lit(len(base.rstrip("/")) + 2), F.length(path)), "/")
