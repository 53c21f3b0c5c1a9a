"""Glob, ignore-file and subscription patterns, lowered on the driver to Column predicates.

A glob becomes a literal prefix (pushed to the scan as a prefix test), bounds on the
number of segments, and one regular expression that Java and Python read alike.

Syntax: ``*`` and ``?`` within a segment, ``[abc]`` ``[a-z]`` ``[!x]`` ``[^x]``, ``{a,b}`` nested,
``**`` as a whole segment for any number of segments, ``\\`` to take the next
character as it is, leading ``!`` to negate (each toggles). Unless dot is set,
wildcards at a segment's start don't match a leading dot.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set(".^$+()|{}[]\\*?/-&~#")


@dataclass(frozen=True)
class Lowered:
    prefix: str
    least: int
    most: int | None
    regex: str
    negated: bool
    nocase: bool = False

    def matches(self, path: str) -> bool:
        return (re.fullmatch(self.regex, path, re.S | (re.I if self.nocase else 0)) is not None) != self.negated

    def column(self, path: Column) -> Column:
        """Predicate on a path column."""
        test = path.rlike(("(?isu)" if self.nocase else "(?s)") + f"^(?:{self.regex})\\z")
        if not self.nocase and self.prefix:
            test = path.startswith(self.prefix) & test
        if self.most is not None:
            n = F.size(F.split(path, "/"))
            test = n.between(self.least, self.most) & test
        return ~test if self.negated else test


def _quote(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def split_top(text: str, at: str) -> list[str]:
    """Cut at a character outside brackets and braces."""
    out, level, k, cur, square = [], 0, 0, "", False
    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text):
            cur += text[k : k + 2]
            k += 2
            continue
        if square:
            square = c != "]"
        elif c == "[" and "]" in text[k + 2 :]:
            square = True
        elif c == "{":
            level += 1
        elif c == "}" and level:
            level -= 1
        elif c == at and not level:
            out.append(cur)
            cur = ""
            k += 1
            continue
        cur += c
        k += 1
    return [*out, cur]


def expand(text: str) -> list[str]:
    """All alternatives of braces; a brace without comma or end is literal."""
    k = 0
    while k < len(text):
        if text[k] == "\\":
            k += 2
            continue
        if text[k] == "{":
            level, j = 0, k
            while j < len(text):
                if text[j] == "\\":
                    j += 1
                elif text[j] == "{":
                    level += 1
                elif text[j] == "}":
                    level -= 1
                    if not level:
                        break
                j += 1
            if j >= len(text):
                return [text]
            inner = split_top(text[k + 1 : j], ",")
            if len(inner) > 1:
                return [head for part in inner for head in expand(text[:k] + part + text[j + 1 :])]
        k += 1
    return [text]


def _segment(text: str, dot: bool) -> str:
    out, k = "", 0
    if not dot and text[:1] in ("*", "?", "["):
        out = r"(?!\.)"
    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text):
            out += _quote(text[k + 1])
            k += 2
            continue
        if c == "*":
            while text[k + 1 : k + 2] == "*":
                k += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := text.find("]", k + 2)) > 0:
            body = text[k + 1 : end]
            negate = body[:1] in ("!", "^")
            body = body[1:] if negate else body
            body = body.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&").replace("^", "\\^")
            out += f"[^/{body}]" if negate else f"[{body}]"
            k = end
        else:
            out += _quote(c)
        k += 1
    return out


def _one(pattern: str, dot: bool) -> tuple[str, str, int, int | None]:
    """Regex, literal prefix, and bounds on the number of slash-cut parts."""
    parts = pattern.split("/")
    regex, least, wild = "", 0, False
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            wild = True
            # The star-star takes whole segments, also hidden ones below it.
            regex += ".*" if last else "(?:[^/]*/)*"
            continue
        least += 1
        regex += _segment(part, dot) + ("" if last else "/")
    literal = re.match(r"[^*?\[\\{]*", pattern)[0]
    if len(literal) < len(pattern):
        literal = literal[: literal.rfind("/") + 1]
    return regex, literal, least, None if wild else least


@lru_cache(1000)
def lower(pattern: str, dot: bool = False, nocase: bool = False) -> Lowered:
    if not pattern:
        raise ValueError("empty pattern")
    negated = False
    while pattern.startswith("!"):
        negated, pattern = not negated, pattern[1:]
    forms = expand(pattern)
    # Alternatives of braces match hidden names, as a name in braces is spelled out.
    found = [_one(p, dot or len(forms) > 1) for p in forms]
    prefix = found[0][1]
    for _, literal, _, _ in found[1:]:
        while not literal.startswith(prefix):
            prefix = prefix[:-1]
    most = None if any(m is None for *_, m in found) else max(m for *_, m in found)
    regex = "|".join(f"(?:{r})" for r, *_ in found) if len(found) > 1 else found[0][0]
    return Lowered(prefix, min(n for *_, n, _ in found), most, regex, negated, nocase)


def match(pattern: str, path: str, dot: bool = False, nocase: bool = False) -> bool:
    return lower(pattern, dot, nocase).matches(path)


def any_of(patterns: list[str], path: Column, dot: bool = False, nocase: bool = False) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | lower(p, dot, nocase).column(path)
    return out


def subscription(pattern: str) -> str:
    """Regex of a subscription: ``**`` any characters, ``*`` within a segment, all else literal."""
    out = ""
    for part in re.split(r"(\*\*|\*)", pattern):
        out += {"**": ".*", "*": "[^/]*"}.get(part) or "".join(map(_quote, part))
    return f"^{out}$"


@dataclass(frozen=True)
class Ignore:
    """A line of an ignore file."""

    pattern: str
    negated: bool
    directory: bool
    anchored: bool

    def lowered(self) -> list[Lowered]:
        base = self.pattern if self.anchored else f"**/{self.pattern}"
        return [lower(p, dot=True) for p in ([] if self.directory else [base]) + [f"{base}/**"]]

    def column(self, relative: Column) -> Column:
        out = F.lit(False)
        for p in self.lowered():
            out = out | p.column(relative)
        return out


def parse_ignore(text: str) -> list[Ignore]:
    out = []
    for line in text.split("\n"):
        line = line.rstrip("\r").rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        line = line[1:] if line.startswith(("\\#", "\\!")) else line
        if "***" in line:
            raise ValueError(f"bad pattern: {line}")
        directory = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        out.append(Ignore(line.lstrip("/"), negated, directory, anchored))
    return out


def last_match(rules: list[Ignore], relative: Column) -> Column:
    """Whether the last rule that fits a path isn't a negated one."""
    out = F.lit(False)
    for r in rules:
        out = F.when(r.column(relative), F.lit(not r.negated)).otherwise(out)
    return out
