"""Secret scans: fixed patterns plus a token-efficiency test.

A tokenizer's vocabulary compresses natural text, identifiers and paths to
several characters a token; a random string costs a token for every one to two
characters. Each run of at least MIN_LENGTH key-like characters, or piece of a
run that pattern matches leave, is encoded with a public byte-pair vocabulary (the tiktoken
library), and is a secret when characters / tokens is below MAX_RATIO, unless it
is a known digest (hex of the length of MD5, SHA-1, SHA-2), a UUID, a number, a
date, or an identifier (two or more words of letters joined by ``_``, ``-``, ``/``
or camel case, with at most a short number at the end of each part; every word
must itself have MAX_RATIO characters a token, in lower case). In a run that is
none, each stretch of parts between separators that are below MAX_RATIO is tested
in the same way, and then each of these parts.

Kinds of spans, in order: assign, access, hex (the patterns), token (the test).
Offsets are code points, ends exclusive.

Defined cases: a null or empty text has no spans; a text is scanned whole,
whatever its length; equal texts have equal spans; rows with a null id are
scanned too; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)
NUMERIC = re.compile(r"[0-9+/_=-]+")
SEPARATORS = re.compile(r"[+/_=-]+")
PADDING = re.compile(r"=*")
PIECE = re.compile(r"(?<![A-Za-z0-9])(?P<uuid>[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12})(?![A-Za-z0-9])|[A-Za-z0-9]+")
PART = re.compile(r"([A-Za-z]+)[0-9]{0,4}")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
MIN_LENGTH = 20
MAX_RATIO = 2.0


class Scanner:
    """Finds spans in texts. ranks: token bytes to rank, of a tiktoken file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, min_length: int = MIN_LENGTH, max_ratio: float = MAX_RATIO) -> None:
        import tiktoken

        self.encoding = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.candidate = CANDIDATE if min_length == MIN_LENGTH else re.compile(rf"[A-Za-z0-9+/_=-]{{{min_length},}}")
        self.min_length = min_length
        self.max_ratio = max_ratio

    def patterns(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
        return found

    def is_dense(self, text: str) -> bool:
        """Whether the text has fewer than max_ratio characters a token."""
        # A long run is encoded in pieces: the cost of one encode call grows faster than its length.
        tokens = sum(len(self.encoding.encode_ordinary(text[k : k + 512])) for k in range(0, len(text), 512))
        return len(text) < self.max_ratio * tokens

    def is_identifier(self, text: str) -> bool:
        parts = [x for x in SEPARATORS.split(text) if x]
        if len(parts) > 1 and NUMERIC.fullmatch(parts[-1]) and len(parts[-1]) <= 4:
            parts.pop()
        words: list[str] = []
        for part in parts:
            m = PART.fullmatch(part)
            if not m:
                return False
            words += WORD.findall(m[1])
        return len(words) > 1 and all(len(w) > 1 for w in words) and not any(self.is_dense(w.lower()) for w in words)

    def is_random(self, text: str) -> bool:
        if DIGEST.fullmatch(text) or UUID.fullmatch(text) or NUMERIC.fullmatch(text):
            return False
        return self.is_dense(text) and not self.is_identifier(text)

    def random_parts(self, run: str, a: int) -> list[tuple[int, int, int]]:
        """The token spans of a run that starts at a: the whole of it, or else its stretches of dense parts."""
        if len(run) < self.min_length:
            return []
        if self.is_random(run):
            return [(a, 3, a + len(run))]
        if DIGEST.fullmatch(run) or UUID.fullmatch(run) or not SEPARATORS.search(run):
            return []
        found: list[tuple[int, int]] = []
        stretch: list[tuple[int, int]] = []

        def close() -> None:
            if stretch:
                whole = (stretch[0][0], stretch[-1][1])
                found.extend([whole] if self.is_key(run, *whole) else [x for x in stretch if self.is_key(run, *x)])
                stretch.clear()

        for m in PIECE.finditer(run):
            if m["uuid"] or DIGEST.fullmatch(m[0]):
                close()
            elif len(m[0]) > 2:  # shorter ones are inside of keys as well as of paths
                if NUMERIC.fullmatch(m[0]) or not self.is_dense(m[0]):
                    close()
                else:
                    stretch.append(m.span())
        close()
        return [(a + s, 3, a + e + len(PADDING.match(run, e)[0])) for s, e in found]

    def is_key(self, run: str, a: int, b: int) -> bool:
        return b - a >= self.min_length and self.is_random(run[a:b])

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        found = self.patterns(text)
        base: list[list[int]] = []  # disjoint, in order
        for a, b in sorted((a, b) for a, _, b in found):
            if base and a <= base[-1][1]:
                base[-1][1] = max(base[-1][1], b)
            else:
                base.append([a, b])
        at = 0
        for m in self.candidate.finditer(text):
            a, b = m.span()
            while at < len(base) and base[at][1] <= a:
                at += 1
            if at == len(base) or base[at][0] >= b:
                found += self.random_parts(m[0], a)
                continue
            # What the base spans leave of the run, each piece on its own, without the separators beside a span.
            while a < b:
                cut = at < len(base) and base[at][0] < b
                end = max(a, base[at][0]) if cut else b
                piece = text[a:end]
                if a > m.start():
                    piece = piece.lstrip("+/_=-")
                a = end - len(piece)
                found += self.random_parts(piece.rstrip("+/_=-") if cut else piece, a)
                if not cut:
                    break
                a = base[at][1]
                if a < b:
                    at += 1
        found.sort()
        return found


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def scanner(spark: SparkSession, ranks_path: str | None = None, **options) -> Callable[[], Scanner]:
    """Reads the vocabulary (fixed size, 50k tokens) on the driver; returns what makes a Scanner in a worker."""
    import public_tokenizers

    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")))
    pattern = public_tokenizers.PATTERN
    return lambda: Scanner(ranks.value, pattern, **options)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, **options) -> DataFrame:
    """(id, spans array of (kind, start, end, text)) for each row."""
    from treelake.llm._arrow import col, map_texts

    make = scanner(df.sparkSession, ranks_path, **options)
    kind = df.select(col(id_col)).schema[0].dataType.simpleString()

    def start():
        s = make()

        def run(ids, texts):
            yield {"i": ids, "spans": [[{"kind": KINDS[k], "start": a, "end": b, "text": t[a:b]} for a, k, b in s.spans(t)] for t in texts]}

        return run

    out = map_texts(df, id_col, text_col, f"i {kind}, spans array<struct<kind string, start long, end long, text string>>", start)
    return out.selectExpr(f"i as `{id_col}`", "spans")


def redact_text(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span, overlapping ones joined, replaced by ``<SECRET>``."""
    if not spans or text is None:
        return text
    out, at, until = [], 0, -1
    for a, _, b in spans:
        if a >= until:
            out += [text[at:a] if until < 0 else text[max(at, until) : a], "<SECRET>"]
        until = max(until, b)
        at = until
    return "".join([*out, text[until:]])


def scan_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_token, base_sha256, spans): the same scan, spans as kind:start:end joined by commas."""
    import hashlib

    from treelake.llm._arrow import col, map_texts

    make = scanner(df.sparkSession, ranks_path)
    kind = df.select(col(id_col)).schema[0].dataType.simpleString()
    names = [f"n_{k}" for k in KINDS]

    def start():
        s = make()

        def run(ids, texts):
            found = [s.spans(t) for t in texts]
            text = [[f"{KINDS[k]}:{a}:{b}" for a, k, b in x] for x in found]
            base = [",".join(w for w, (_, k, _) in zip(ws, x) if k < 3) for ws, x in zip(text, found)]
            yield {
                "i": ids,
                **{n: [sum(y[1] == k for y in x) for x in found] for k, n in enumerate(names)},
                "base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in base],
                "spans": [",".join(ws) for ws in text],
            }

        return run

    schema = f"i {kind}, {', '.join(f'{n} long' for n in names)}, base_sha256 string, spans string"
    return map_texts(df, id_col, text_col, schema, start).selectExpr(f"i as `{id_col}`", *names, "base_sha256", "spans")


def redact(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", ranks_path: str | None = None) -> DataFrame:
    """df with each secret in its text replaced, and the count of characters set to the new text's."""
    from collections.abc import Iterator

    import pyarrow as pa

    from treelake.llm._arrow import slices

    make = scanner(df.sparkSession, ranks_path)
    at = df.columns.index(text_col)
    chars = df.columns.index(chars_col) if chars_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = make()
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                texts = part.column(at).to_pylist()
                new = [redact_text(t, s.spans(t)) for t in texts]
                part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
                if chars is not None:
                    field = part.schema.field(chars)
                    n = [old if t == was else len(t) for t, was, old in zip(new, texts, part.column(chars).to_pylist())]
                    part = part.set_column(chars, field, pa.array(n, field.type))
                yield part

    return df.mapInArrow(run, df.schema)
