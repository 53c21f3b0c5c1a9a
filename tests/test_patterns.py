"""Glob, ignore and subscription rules against expected values written by hand."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treelake.functions import patterns


@pytest.mark.parametrize(
    ("pattern", "path", "expected"),
    [
        ("*.ts", "a.ts", True),
        ("*.ts", "d/a.ts", False),
        ("**/*.ts", "a.ts", True),
        ("**/*.ts", "x/y/a.ts", True),
        ("src/**", "src/a/b", True),
        ("src/**", "lib/a", False),
        ("a/**/b", "a/b", True),
        ("a/**/b", "a/x/y/b", True),
        ("?.md", "a.md", True),
        ("?.md", "ab.md", False),
        ("[abc].x", "b.x", True),
        ("[!abc].x", "b.x", False),
        ("[^abc].x", "d.x", True),
        ("[a-c]1", "b1", True),
        ("{a,b}.ts", "b.ts", True),
        ("{a,{b,c}d}.ts", "cd.ts", True),
        ("{a}.ts", "{a}.ts", True),
        ("*.ts", ".a.ts", False),
        (".*", ".a", True),
        ("!*.ts", "a.js", True),
        ("!!*.ts", "a.ts", True),
        (r"\*.ts", "*.ts", True),
        (r"\*.ts", "a.ts", False),
        ("a+b.(c)", "a+b.(c)", True),
    ],
)
def test_match(pattern, path, expected):
    assert patterns.match(pattern, path) is expected


def test_match_options():
    assert patterns.match("*", ".a", dot=True)
    assert patterns.match("*.TS", "a.ts", nocase=True)
    with pytest.raises(ValueError, match="empty"):
        patterns.match("", "a")


def segments_match(pattern, path):
    """Rules of literal, * and ** segments, tried one by one."""
    if not pattern:
        return not path
    if pattern[0] == "**":
        return any(segments_match(pattern[1:], path[k:]) for k in range(len(path) + 1))
    return bool(path) and re.fullmatch(re.escape(pattern[0]).replace(r"\*", "[^/]*"), path[0]) is not None and segments_match(pattern[1:], path[1:])


@settings(max_examples=300)
@given(st.lists(st.sampled_from(["a", "b", "*", "a*", "**"]), min_size=1, max_size=4), st.lists(st.sampled_from(["a", "b", "ab"]), min_size=1, max_size=5))
def test_match_equals_segment_rules(pattern, path):
    if pattern[-1] == "**":
        return
    assert patterns.match("/".join(pattern), "/".join(path)) == segments_match(pattern, path)


def test_lowering_has_prefix_and_bounds():
    low = patterns.lower("src/lib/*.ts")
    assert (low.prefix, low.least, low.most) == ("src/lib/", 3, 3)
    assert patterns.lower("src/{a,b}/**").prefix == "src/"


def test_column_form_agrees(spark):
    paths = ["a.ts", "x/a.ts", ".a.ts", "src/a/b.md", "src/[x].ts", "b1"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for pattern in ("*.ts", "**/*.ts", "src/**", "[a-c]1", "{a,b}*", "!*.ts", "src/\\[x\\].ts"):
        got = {r["p"] for r in df.where(patterns.lower(pattern).column(df["p"])).collect()}
        assert got == {p for p in paths if patterns.match(pattern, p)}, pattern


def test_ignore_file():
    rules = patterns.parse_ignore("# c\n\n*.log\n!keep.log\n/top\ndir/\n\\#x\n")
    assert [(r.pattern, r.negated, r.directory, r.anchored) for r in rules] == [
        ("*.log", False, False, False),
        ("keep.log", True, False, False),
        ("top", False, False, True),
        ("dir", False, True, False),
        ("#x", False, False, False),
    ]
    with pytest.raises(ValueError, match="bad"):
        patterns.parse_ignore("a***b")


def test_subscription():
    assert re.match(patterns.subscription("/u/1*/*.dat"), "/u/12/0.dat")
    assert not re.match(patterns.subscription("/u/*"), "/u/1/2")
    assert re.match(patterns.subscription("/u/**"), "/u/1/2")
