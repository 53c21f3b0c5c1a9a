"""Content search."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.functions import patterns

#: Word boundary over ASCII word characters, as Java's \\b is over Unicode ones.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
SNIFF = 8192


@dataclass(frozen=True)
class Grep:
    pattern: str
    literal: bool = False
    ignore_case: bool = False
    word: bool = False
    invert: bool = False
    before: int = 0
    after: int = 0
    max_count: int | None = None
    files_only: bool = False
    glob: str | None = None


def compiled(g: Grep) -> str:
    body = re.sub(r"([.^$+()|{}\[\]\\*?])", r"\\\1", g.pattern) if g.literal else g.pattern
    if g.word:
        body = f"{BOUNDARY}(?:{body}){BOUNDARY}"
    return ("(?iu)" if g.ignore_case else "") + body


def is_text(content: Column) -> Column:
    """No null byte and at most 30 % control characters (tab, line ends apart) in the first characters."""
    head = F.substring(content, 1, SNIFF)
    controls = F.regexp_count(head, F.lit(r"[\x01-\x08\x0B\x0C\x0E-\x1F]"))
    return ~head.contains("\0") & (controls <= F.length(head) * 0.3)


def grep(contents: DataFrame, g: Grep) -> DataFrame:
    """(path, line, column, content, match, before, after): a row for each occurrence.

    Lines and columns count from 1, columns in code points. A text's hits, their columns and their context are
    found as arrays of its own row and cut to max_count there; then they are exploded, with nothing else of
    the text. So there is no join, no window and no shuffle. max_count is for each file, in order of line and column.
    """
    rows = contents.where((F.col("content") != "") & is_text(F.col("content")))
    if g.glob:
        rows = rows.where(patterns.lower(g.glob if "/" in g.glob else f"**/{g.glob}", dot=True).column(F.col("path")))
    rx = compiled(g)
    if not g.invert:
        rows = rows.where(F.col("content").rlike(rx))  # whole texts without a hit go first
    rows = rows.select("path", F.split("content", "\n", -1).alias("lines"))
    numbered = F.transform("lines", lambda x, at: F.struct(at.alias("at"), x.alias("content")))
    rows = rows.withColumn("found", F.filter(numbered, lambda x: ~x["content"].rlike(rx) if g.invert else x["content"].rlike(rx)))

    def hits(x: Column) -> Column:
        """Of a line: structs of line, column, content, match, before and after."""
        at = x["at"]
        context = [
            F.slice("lines", F.greatest(at + 1 - g.before, F.lit(1)), F.least(F.lit(g.before), at)).alias("before"),
            F.slice("lines", at + 2, F.lit(g.after)).alias("after"),
        ]
        one = lambda column, match: F.struct((at + 1).alias("line"), column.alias("column"), x["content"].alias("content"), match.alias("match"), *context)
        if g.invert:
            return F.array(one(F.lit(1), F.lit("")))
        matches = F.filter(F.regexp_extract_all(x["content"], F.lit(rx), F.lit(0)), lambda m: m != "")
        if limit is not None:
            matches = F.slice(matches, F.lit(1), F.lit(limit))
        # A hit begins after the text before it, which is what stands between the hits so far; one pass adds it up.
        pairs = F.filter(F.arrays_zip(F.split(x["content"], rx, -1).alias("gap"), matches.alias("match")), lambda p: p["match"].isNotNull())
        start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<column:int,match:string>>").alias("all"))

        def add(s: Column, p: Column) -> Column:
            column = s["next"] + F.length(p["gap"])
            return F.struct((column + F.length(p["match"])).alias("next"), F.concat(s["all"], F.array(F.struct(column.alias("column"), p["match"].alias("match")))).alias("all"))

        return F.transform(F.aggregate(pairs, start, add, lambda s: s["all"]), lambda h: one(h["column"], h["match"]))

    limit = 1 if g.files_only else g.max_count
    every = F.flatten(F.transform("found", hits))
    rows = rows.select("path", F.explode(every if limit is None else F.slice(every, F.lit(1), F.lit(limit))).alias("hit"))
    return rows.select("path", *(f"hit.{c}" for c in ("line", "column", "content", "match", "before", "after")))


def counts(matches: DataFrame) -> DataFrame:
    """(files, matches) of a grep."""
    return matches.agg(F.countDistinct("path").alias("files"), F.count("*").alias("matches"))


def term_count(content: Column, term: str, ignore_case: bool = False) -> Column:
    """Occurrences that don't overlap."""
    text, t = (F.lower(content), term.lower()) if ignore_case else (content, term)
    return ((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)).cast("long")


def search(files: DataFrame, contents: DataFrame, pattern: str, path: str = "/", exclude: list[str] | None = None, max_depth: int | None = None, hidden: bool = False, limit: int | None = None, term: str | None = None) -> DataFrame:
    """(path, type, size[, count]) of entries that a glob fits, by path; limit after the order.

    exclude fits whole relative paths or any segment.
    """
    from treelake.functions import paths

    rel = F.substring(F.col("path"), F.lit(len(path.rstrip("/")) + 2), F.length("path"))
    parts = F.split(rel, "/")
    test = patterns.lower(pattern if "/" in pattern or "**" in pattern else f"**/{pattern}", dot=hidden).column(rel)
    for p in exclude or []:
        low = patterns.lower(p, dot=True)
        test &= ~(low.column(rel) | F.exists(parts, low.column))
    if max_depth is not None:
        test &= F.size(parts) <= max_depth
    if not hidden:
        test &= ~F.exists(parts, lambda s: s.startswith("."))
    out = files.where(paths.within(F.col("path"), path)).where(test).select("path", "type", "size").orderBy("path")
    out = out.limit(limit) if limit is not None else out
    if term is None:
        return out
    return out.join(contents.select("path", term_count(F.col("content"), term).alias("count")), "path", "left").withColumn("count", F.coalesce("count", F.lit(0))).orderBy("path")


def tool_search(files: DataFrame, contents: DataFrame, text: str) -> DataFrame:
    """``grep:<pattern>`` searches content, anything else is a glob."""
    return grep(contents, Grep(text[5:])) if text.startswith("grep:") else search(files, contents, text)
