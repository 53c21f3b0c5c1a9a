"""URL filter: allow and block rules in a trie over host labels and path segments.

A rule is (host, path prefix, verdict). The trie is keyed by the host's labels
from the last to the first (``org``, ``example``, ``www``), then by the path's
segments. A rule fits its host and all its subdomains when the url's path
starts with the rule's path; a rule path that ends inside a segment (``/en/7``)
hangs below its last whole segment as a prefix of the next one. The longest
fitting rule wins: more host labels first, then the longer path; of equal rules
block wins. Urls that no rule fits get the default verdict.

The compiled trie is broadcast. Its size is checked: at most RULES_PER_TRIE
rules go into one trie, and longer lists are cut into several tries that are
applied one after the other, each pass keeping the better match, so that a
worker holds one bounded trie at a time whatever the list's length.

Defined cases: a null url, or one without ``://``, has empty host and path (a
rule with an empty host fits every host, and no other fits the empty one). The
host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or
the end, A-Z lower-cased, port and user info included. Repeated urls are judged
alike; an empty table gives an empty result; other columns are dropped unless
named in ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from treelake.llm._arrow import col, lower_ascii

#: Most rules in one broadcast trie (about 100 MB of Python objects in a worker).
RULES_PER_TRIE = 250_000
_HOST_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # "allow" or "block"

    @classmethod
    def parse(cls, text: str, verdict: str) -> Rule:
        """``example.com/en/7`` -> host ``example.com``, path ``/en/7``."""
        host, slash, path = text.partition("/")
        return cls(lower_ascii(host), slash + path, verdict)

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url, both empty if it is null or has no ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    m = _HOST_END.search(rest)
    if m is None:
        return lower_ascii(rest), ""
    host, path = rest[: m.start()], rest[m.start() :]
    end = _PATH_END.search(path)
    return lower_ascii(host), path[: end.start()] if end else path


class Node:
    __slots__ = ("labels", "lengths", "partial", "paths", "rule")

    def __init__(self) -> None:
        self.labels: dict[str, Node] = {}  # next host label, towards the left
        self.paths: dict[str, Node] = {}  # next whole path segment
        self.partial: dict[str, Rule] = {}  # rules that end inside the next segment
        self.lengths: list[int] = []  # lengths of those, the longest first
        self.rule: Rule | None = None  # the rule that ends here


class UrlTrie:
    def __init__(self, rules: Sequence[Rule]) -> None:
        self.root = Node()
        for rule in rules:
            self.add(rule)

    def add(self, rule: Rule) -> None:
        node = self.root
        for label in reversed(rule.host.split(".")) if rule.host else ():
            node = node.labels.setdefault(label, Node())
        if not rule.path:
            node.rule = _stricter(node.rule, rule)
            return
        *whole, last = rule.path.split("/")
        for segment in whole:
            node = node.paths.setdefault(segment, Node())
        node.partial[last] = _stricter(node.partial.get(last), rule)
        if len(last) not in node.lengths:
            node.lengths = sorted([*node.lengths, len(last)], reverse=True)

    def find(self, host: str, path: str) -> tuple[tuple[int, int], Rule] | None:
        """The longest rule that fits, with its rank (host labels, path length)."""
        node, chain = self.root, [self.root]
        for label in reversed(host.split(".")) if host else ():
            node = node.labels.get(label)
            if node is None:
                break
            chain.append(node)
        for depth in range(len(chain) - 1, -1, -1):  # the most host labels first
            if (rule := _longest(chain[depth], path)) is not None:
                return (depth, len(rule.path)), rule
        return None


def _stricter(old: Rule | None, new: Rule) -> Rule:
    return new if old is None or new.verdict == "block" else old


def _longest(node: Node, path: str) -> Rule | None:
    best = node.rule
    segments = path.split("/")
    for k, segment in enumerate(segments):
        for n in node.lengths:
            if n <= len(segment) and (rule := node.partial.get(segment[:n])) is not None:
                best = rule
                break
        if k == len(segments) - 1:
            break
        node = node.paths.get(segment)
        if node is None:
            break
    return best


def filter_urls(
    df: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", rules_per_trie: int = RULES_PER_TRIE
) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of df.

    Rows with a null id are judged like others. See the module for the rules.
    """
    spark = df.sparkSession
    id_type = df.select(col(id_col)).schema[0].dataType.simpleString()
    out = df.select(col(id_col).alias("i"), col(url_col).cast("string").alias("u"))
    schema = f"i {id_type}, u string, host string, path string, rule string, verdict string, labels int, length int"
    shards = [rules[k : k + rules_per_trie] for k in range(0, len(rules), rules_per_trie)] or [[]]
    for shard in shards:
        packed = spark.sparkContext.broadcast([(r.host, r.path, r.verdict) for r in shard])
        out = out.mapInArrow(_judge(packed, default), schema)
    return out.selectExpr(f"i as `{id_col}`", "host", "path", "rule", "verdict")


def _judge(packed, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = UrlTrie([Rule(*r) for r in packed.value])
        for batch in batches:
            urls = batch.column(1).to_pylist()
            if batch.num_columns > 2:
                before = list(zip(*(c.to_pylist() for c in batch.columns[2:])))
            else:
                before = [(*split_url(u), None, default, -1, -1) for u in urls]
            rows = []
            for host, path, rule, verdict, labels, length in before:
                found = trie.find(host, path)
                if found and (found[0] > (labels, length) or found[0] == (labels, length) and found[1].verdict == "block"):
                    (labels, length), hit = found
                    rule, verdict = hit.text, hit.verdict
                rows.append((host, path, rule, verdict, labels, length))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["i", "u", "host", "path", "rule", "verdict", "labels", "length"]
            )

    return run
