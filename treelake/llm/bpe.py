"""BPE encoding and decoding with forced boundaries.

A byte-pair merge can only make tokens of the vocabulary. So where two
neighbouring symbols never stand side by side inside any token, no merge
crosses that place: it is a certain cut. A word is split at its certain cuts, the
fragments are encoded on their own and the ids concatenated; a long run of odd
bytes thus falls into short pieces, and fragments recur and are kept in a
bounded cache.

The vocabulary is a BPE with word ends: text is normalised (NFC, each run of
white space to one space, lower case), split into words by a fixed pattern, and
the last symbol of each word carries the suffix ``</w>``. Words of ASCII and
common Latin letters are split here; texts with other characters go through the
tokenizers library's own normaliser and word splitter (its Unicode tables may
differ from Python's), and through the same encoder after that.

Decoding joins the tokens' strings with a space, as the library does for a file
without decoder.

Defined cases: a null or empty text has no ids and decodes to the empty text;
special tokens' strings in a text become their ids; very long texts and words
are encoded whole; equal texts have equal ids; an empty table gives an empty
result.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from operator import concat
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Fixed value: the word pattern of the vocabulary's file, for the characters of SIMPLE.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\s{_LETTER}0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: Texts of these characters only are normalised and split here.
SIMPLE = re.compile(r"[\t\n\r -~\xa1-įı-ſ–—‘-”…€]*")
#: Characters of cached words before the cache is emptied (about 60 MB in a worker).
CACHE_CHARACTERS = 3 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


class Bpe:
    """Encoder and decoder of a tokenizers file of this kind."""

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import WhitespaceSplit

        data = json.loads(file)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: Merges of a fragment that ends its word, and of one that doesn't.
        self.last = Tokenizer(BPE(self.vocab, merges, end_of_word_suffix=self.suffix))
        self.middle = Tokenizer(BPE(self.vocab, merges))
        self.last.pre_tokenizer = self.middle.pre_tokenizer = WhitespaceSplit()
        self.symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        library = Tokenizer.from_str(file)
        self.normalize, self.pre = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        #: Pairs of neighbouring byte symbols inside some token; those whose second symbol ends the word.
        self.pairs: set[str] = set()
        self.end_pairs: set[str] = set()
        for token in self.vocab:
            ends = token.endswith(self.suffix) and token != self.suffix
            body = token[: -len(self.suffix)] if ends else token
            self.pairs.update(body[k : k + 2] for k in range(len(body) - 1 - ends))
            if ends and len(body) > 1:
                self.end_pairs.add(body[-2:])
        self.bytes_of = {c: b for b, c in enumerate(self.symbols)}
        self.words: dict[str, bytes] = {}
        self.middles: dict[str, tuple[int, ...]] = {}
        self.used = 0

    def split_forced(self, symbols: str) -> list[str]:
        """The byte symbols of a word, cut where no token can cross."""
        n = len(symbols)
        if n == 1 or (symbols[-2:] in self.end_pairs and self.pairs.issuperset(map(concat, symbols, symbols[1:-1]))):
            return [symbols]
        cuts = [k for k in range(1, n - 1) if symbols[k - 1 : k + 1] not in self.pairs]
        if n > 1 and symbols[-2:] not in self.end_pairs:
            cuts.append(n - 1)
        return [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, n])]

    def _merged(self, merges: Tokenizer, parts: list[str], seen: dict[str, tuple[int, ...]]) -> None:
        """Put the ids of fragments, each merged on its own, into seen."""
        for k in range(0, len(parts), 4096):
            some = parts[k : k + 4096]
            encoding = merges.encode(" ".join(some))
            ids, at = encoding.ids, encoding.word_ids
            start = 0
            for n, part in enumerate(some):
                end = start + 1
                while end < len(at) and at[end] == n:
                    end += 1
                seen[part] = tuple(ids[start:end])
                start = end

    def fill(self, words: set[str]) -> None:
        """Put the ids of words (normalised text) into the cache."""
        table, new = self.symbols, []
        for w in words:
            symbols = w if w.isascii() and w.isprintable() else "".join([table[b] for b in w.encode()])
            new.append((w, self.split_forced(symbols)))
        if self.used > CACHE_CHARACTERS:
            self.middles.clear()
            self.used = 0
        self._merged(self.middle, list({p for _, parts in new for p in parts[:-1]}.difference(self.middles)), self.middles)
        lasts: dict[str, tuple[int, ...]] = {}
        self._merged(self.last, list({parts[-1] for _, parts in new}), lasts)
        for w, parts in new:
            ids = lasts[parts[-1]]
            if len(parts) > 1:
                ids = (*(x for p in parts[:-1] for x in self.middles[p]), *ids)
            self.words[w] = struct.pack(f"<{len(ids)}I", *ids)
            self.used += len(w)

    def split_words(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if SIMPLE.fullmatch(text):
            return WORD.findall(_lower(unicodedata.normalize("NFC", text)))
        back = self.bytes_of
        return [bytes([back[c] for c in symbols]).decode() for symbols, _ in self.pre(self.normalize(text))]

    def _ids(self, words: list[str]) -> bytes:
        """Ids of words, as little-endian unsigned 32-bit integers."""
        if missing := set(words).difference(self.words):
            if self.used > CACHE_CHARACTERS:
                self.words.clear()
                missing = set(words)
            self.fill(missing)
        return b"".join(map(self.words.__getitem__, words))

    def _plain(self, text: str) -> bytes:
        return self._ids(self.split_words(text)) if text else b""

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special_at is None or "<|" not in text or len(parts := self.special_at.split(text)) == 1:
            return self._plain(text)
        return b"".join(struct.pack("<I", self.special[p]) if k % 2 else self._plain(p) for k, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in memoryview(ids).cast("I")])


_LOADED: dict[str, Bpe] = {}


def load(file: str) -> Bpe:
    """The Bpe of a file, one in each worker, so that its caches outlive a task."""
    if file not in _LOADED:
        _LOADED.clear()
        _LOADED[file] = Bpe(file)
    return _LOADED[file]


def _lower(text: str) -> str:
    """Lower case of the characters of SIMPLE; each has a one-character lower case."""
    return text.lower()


def read_file(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, n_tokens, ids array<int>) for each row; path: the vocabulary's file, read on the driver."""
    import numpy as np
    import pyarrow as pa

    from treelake.llm._arrow import col, map_columns

    file = df.sparkSession.sparkContext.broadcast(read_file(path))
    rows = df.select(col(id_col).alias("i"), col(text_col).cast("string").alias("t"), *(col(c).alias(f"x{k}") for k, c in enumerate(carry)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name != "t"}

    def start():
        bpe = load(file.value)

        def run(keys, texts, *more):
            got = [bpe.encode(t) for t in texts]
            n = np.array([len(g) // 4 for g in got])
            ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), np.frombuffer(b"".join(got), np.int32))
            yield {"i": keys} | {f"x{k}": v for k, v in enumerate(more)} | {"n_tokens": n.tolist(), "ids": ids}

        return run

    out = map_columns(rows, ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", n_tokens long, ids array<int>", start)
    return out.select(out["i"].alias(id_col), *(out[f"x{k}"].alias(c) for k, c in enumerate(carry)), "n_tokens", "ids")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, decoded string) of arrays of ids; null ids decode to null."""
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import StringType

    from treelake.llm._arrow import col

    file = df.sparkSession.sparkContext.broadcast(read_file(path))

    @pandas_udf(StringType())
    def strings(ids: pd.Series) -> pd.Series:
        names = load(file.value).strings
        return ids.map(lambda x: None if x is None else " ".join([names[int(i)] for i in x]))

    return df.select(col(id_col), strings(col(ids_col)).alias("decoded"))


def encode_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the same encoder and decoder, without carrying the ids out."""
    import hashlib

    from treelake.llm._arrow import col, map_texts

    file = df.sparkSession.sparkContext.broadcast(read_file(path))
    kind = df.select(col(id_col)).schema[0].dataType.simpleString()

    def start():
        bpe = load(file.value)

        def run(keys, texts):
            n, a, b = [], [], []
            for t in texts:
                g = bpe.encode(t)
                n.append(len(g) // 4)
                a.append(hashlib.sha256(g).hexdigest())
                b.append(hashlib.sha256(bpe.decode(g).encode()).hexdigest())
            yield {"i": keys, "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

        return run

    out = map_texts(df, id_col, text_col, f"i {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", start)
    return out.selectExpr(f"i as `{id_col}`", "n_tokens", "ids_sha256", "decoded_sha256")
