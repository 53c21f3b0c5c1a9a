"""Sparse checkouts: which paths a list of patterns includes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.functions import paths, patterns

#: Named include lists. More can be added.
PRESETS: dict[str, list[str]] = {
    "typescript": ["**/*.ts", "**/*.tsx", "package.json", "tsconfig.json"],
    "javascript": ["**/*.js", "**/*.jsx", "package.json"],
    "source": ["src/**", "lib/**", "package.json"],
    "web": ["**/*.html", "**/*.css", "**/*.js", "**/*.ts", "**/*.jsx", "**/*.tsx"],
    "config": ["package.json", "tsconfig.json", "*.config.{js,ts,mjs,cjs}", ".env*"],
}


def included(include: list[str], exclude: list[str], relative: Column) -> Column:
    """The last fitting include decides (``!`` takes back); then no exclude may fit. No includes, no paths."""
    out = F.lit(False)
    for p in include:
        negated = p.startswith("!")
        out = F.when(patterns.lower(p.lstrip("!"), dot=True).column(relative), F.lit(not negated)).otherwise(out)
    banned = F.lit(False)
    for p in exclude:
        negated = p.startswith("!")
        banned = F.when(patterns.lower(p.lstrip("!"), dot=True).column(relative), F.lit(not negated)).otherwise(banned)
    return out & ~banned


def cone(directories: list[str], relative: Column) -> Column:
    """Top-level entries, all below a cone, and the direct children of a cone's ancestors."""
    out = ~relative.contains("/")
    for d in directories:
        d = d.strip("/")
        if any(c in d for c in "*?[{"):
            raise ValueError(f"a cone takes no patterns: {d}")
        out = out | (relative == d) | relative.startswith(d + "/")
        parts = d.split("/")
        for k in range(1, len(parts)):
            above = "/".join(parts[:k])
            out = out | (relative.startswith(above + "/") & ~F.substring(relative, F.lit(len(above) + 2), F.length(relative)).contains("/"))
    return out


def checkout(files: DataFrame, include: list[str], exclude: list[str] | None = None, base: str = "/") -> DataFrame:
    """Files below base that are included."""
    rel = F.substring(F.col("path"), F.lit(len(base.rstrip("/")) + 2), F.length("path"))
    return files.where(paths.within(F.col("path"), base)).where("type = 'file'").where(included(include, exclude or [], rel))


def checkout_cone(files: DataFrame, directories: list[str], base: str = "/") -> DataFrame:
    rel = F.substring(F.col("path"), F.lit(len(base.rstrip("/")) + 2), F.length("path"))
    return files.where(paths.within(F.col("path"), base)).where(cone(directories, rel))


def not_ignored(files: DataFrame, ignore_file: str, base: str = "/") -> DataFrame:
    rel = F.substring(F.col("path"), F.lit(len(base.rstrip("/")) + 2), F.length("path"))
    rules = patterns.parse_ignore(ignore_file)
    return files.where(paths.within(F.col("path"), base)).where("type = 'file'").where(~patterns.last_match(rules, rel))
