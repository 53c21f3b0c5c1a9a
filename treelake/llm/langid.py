"""Language ID: unigrams of pieces, summed over all segmentations.

Each language has probabilities of the pieces of a fixed public vocabulary (and
one for any character outside it). A word's likelihood is the sum, over all ways
to cut it into pieces, of the product of their probabilities; a forward pass
gives it for all languages at once, and a text's is the product over its words.
Training is expectation-maximisation of the same sum: distinct words are counted
by language over all training rows in one aggregate, each pass gives every piece
its expected count over all segmentations (forward and backward), and the counts
are added up across partitions.

The table of probabilities has one row for each piece and one column for each
language. Both are bounded: the vocabulary is fixed, and more than MAX_LANGS
languages are refused.

Defined cases: the prediction is ``und`` with score 0 for a null text or one
without a letter, and where nothing could be learned; rows with a null language
are predicted, not learned from; one whose ``held_out`` is null (a null id) counts
as not held out; of equally likely languages the first in
alphabetical order is taken; texts are read whole; equal texts get equal
predictions; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.llm._arrow import col, map_columns, slices
from treelake.llm._spark import written

MAX_LANGS = 500
CHARACTERS = 1 << 17
PASSES = 2
SPACE = "▁"
#: Characters, and words times languages, of cached words before a worker's cache is emptied.
CACHE_CHARACTERS, CACHE_CELLS = 6 << 20, 1 << 23
#: Characters of text counted or scored at once; columns of a grid whose pieces are looked up at once.
SLICE, COLUMNS = 8 << 20, 1 << 14
_BASE, _MIX, _BITS = 1_000_003, 0x9E3779B97F4A7C15, 21


def read_pieces(path: str | None = None) -> list[str]:
    """Pieces of a sentencepiece file, without its control and byte symbols."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    found = (model.id_to_piece(k) for k in ids if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
    return list(dict.fromkeys(filter(None, found)))


class Pieces:
    """Finds pieces in many words at once, by the hash of each part of a word."""

    def __init__(self, pieces: list[str]) -> None:
        self.n = len(pieces)
        by_length: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(k)
        keys = np.zeros(self.n, np.uint64)
        for n, ks in by_length.items():
            h = np.zeros(len(ks), np.uint64)
            for c in np.array([[ord(c) for c in pieces[k]] for k in ks], np.uint64).T:
                h = h * np.uint64(_BASE) + c
            keys[ks] = h + np.uint64(n)
        self.keys = np.append(keys, np.uint64(0))
        #: Two tables by different bits of a hash; what collides in the first goes to the second, the rest to a sorted list.
        self.tables = [np.full(1 << _BITS, self.n, np.int32) for _ in range(2)]
        left = np.arange(self.n)
        for k, t in enumerate(self.tables):
            at = self._slot(keys[left], k)
            order = np.unique(at, return_index=True)[1]
            t[at[order]] = left[order]
            left = np.delete(left, order)
        if len(left):
            raise ValueError("pieces collide")
        self.longest = max(map(len, pieces), default=1)
        self.powers = np.array([pow(_BASE, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)

    @staticmethod
    def _slot(keys: np.ndarray, k: int) -> np.ndarray:
        return ((keys * np.uint64(_MIX)) >> np.uint64(64 - _BITS * (k + 1))).astype(np.int64) & ((1 << _BITS) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each key, or n."""
        out = self.tables[0][self._slot(keys, 0)]
        miss = self.keys[out] != keys
        if miss.any():
            at = np.flatnonzero(miss)
            second = self.tables[1][self._slot(keys[at], 1)]
            second[self.keys[second] != keys[at]] = self.n
            out[at] = second
        return out

    def hashes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths (with the leading space symbol), and the running hash of each prefix: (width + 1, words)."""
        marked = [SPACE + w for w in words]
        lengths = np.array([len(w) for w in marked])
        wide = int(lengths.max())
        codes = np.frombuffer("".join(w.ljust(wide, "\0") for w in marked).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), wide).astype(np.uint64).T
        out = np.zeros((wide + 1, len(words)), np.uint64)
        for j, c in enumerate(codes):
            out[j + 1] = out[j] * np.uint64(_BASE) + c
        return lengths, out

    def ending(self, hashes: np.ndarray, a: int, b: int) -> np.ndarray:
        """(b - a, longest, words): the piece of k+1 characters that ends at each of the positions a to b, or n."""
        out = np.full((b - a, self.longest, hashes.shape[1]), self.n, np.int32)
        for k in range(1, self.longest + 1):
            first = max(a, k)
            if first < b:
                keys = hashes[first:b] - hashes[first - k : b - k] * self.powers[k] + np.uint64(k)
                out[first - a :, k - 1] = self.find(keys.reshape(-1)).reshape(keys.shape)
        return out


def groups(words: list[str], most: int = 1 << 16) -> Iterator[np.ndarray]:
    """Indices of words of like length; cells (words times width) of a group stay under ``most`` where possible."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        least = lengths[order[start]]
        end = int(np.searchsorted(lengths[order], max(4, least + 2, least * 5 // 4), "right"))
        end = min(end, start + max(1, most // (int(lengths[order[min(end, len(order)) - 1]]) + 2)))
        yield order[start:end]
        start = end


def word_scores(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Natural logarithm of each word's likelihood: (words, languages).

    table: probabilities, a row for each piece, then a row of zeros, then one for
    a character outside the vocabulary.
    """
    out = np.zeros((len(words), table.shape[1]))
    unknown, back, langs = table[pieces.n + 1], pieces.longest, table.shape[1]
    for at in groups(words, max(1, (1 << 18) // max(4, langs))):
        lengths, hashes = pieces.hashes([words[k] for k in at])
        n, wide = len(at), len(hashes) - 1
        columns = max(1, COLUMNS // n)
        # Sums of the last ``back`` positions, oldest first, then those of the columns at hand; all of a word on one scale.
        sums = np.zeros((back + columns, n, langs))
        sums[back - 1] = 1
        scale, result = np.zeros((n, langs)), np.zeros((n, langs))
        for a in range(1, wide + 1, columns):
            b = min(a + columns, wide + 1)
            found = pieces.ending(hashes, a, b)
            for j in range(a, b):
                i = back + j - a
                if n <= 8:
                    new = sums[i - 1] * unknown + (sums[i - back : i][::-1] * table[found[j - a]]).sum(0)
                else:
                    new = sums[i - 1] * unknown
                    for k in range(min(j, back)):
                        new += sums[i - 1 - k] * table[found[j - a, k]]
                ends = lengths == j
                if ends.any():
                    result[ends] = np.log(new[ends]) + scale[ends]
                sums[i] = new
                if j % 4 == 0:
                    top = np.maximum(new, 1e-300)
                    sums[i - back + 1 : i + 1] /= top
                    scale += np.log(top)
            sums[:back] = sums[b - a : b - a + back].copy()
        out[at] = result
    return out


def expected_counts(pieces: Pieces, p: np.ndarray, words: list[str], weight: np.ndarray) -> np.ndarray:
    """Expected count of each piece (and, last, of characters outside) in words of one language.

    p: probabilities as a column of table above.
    """
    total = np.zeros(pieces.n + 2)
    unknown = p[pieces.n + 1]
    for at in groups(words):
        lengths, hashes = pieces.hashes([words[k] for k in at])
        n, wide = len(at), len(hashes) - 1
        found = [ids[: min(j, pieces.longest)] for j, ids in enumerate(pieces.ending(hashes, 0, wide + 1))]
        forward, step = np.zeros((wide + 1, n)), np.ones((wide + 1, n))
        forward[0] = 1
        # forward[j] is scaled by the product of step[1..j], so that no word is too long.
        for j in range(1, wide + 1):
            new = forward[j - 1] * unknown
            over = np.ones(n)
            for k, ids in enumerate(found[j]):
                if k:
                    over = over * step[j - k]
                new += forward[j - 1 - k] * p[ids] / over
            step[j] = np.maximum(new, 1e-300)
            forward[j] = new / step[j]
        backward = np.zeros((wide + 1, n))
        w = weight[at]
        for j in range(wide, 0, -1):
            backward[j][lengths == j] = 1.0
            b = backward[j] / step[j] * (lengths >= j)
            share = forward[j - 1] * unknown * b
            total[pieces.n + 1] += w @ share
            backward[j - 1] += unknown * b
            over = np.ones(n)
            for k, ids in enumerate(found[j]):
                if k:
                    over = over * step[j - k]
                q = p[ids] * b / over
                total += np.bincount(ids, forward[j - 1 - k] * q * w, pieces.n + 2)
                backward[j - 1 - k] += q
    total[pieces.n] = 0
    return total


def normal(counts: np.ndarray, smooth: float = 0.1) -> np.ndarray:
    """Probabilities from counts, with the row of zeros in place.

    The last row is that of any one character outside the vocabulary: the
    outside's share, spread over CHARACTERS of them.
    """
    p = counts + smooth
    p[-2] = 0
    p /= p.sum(0)
    p[-1] /= CHARACTERS
    return p


def train(df: DataFrame, text_col: str, lang_col: str, pieces: list[str], passes: int = PASSES) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the table of probabilities. df: training rows; null languages and texts are left out."""
    spark = df.sparkSession
    rows = df.select(col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("t")).where("lang IS NOT NULL AND t IS NOT NULL")
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not langs:
        return [], np.zeros((len(pieces) + 2, 0))
    # Each pass costs more than its bytes tell, so words are dealt to several tasks for each core.
    words = written(count_words(rows).repartition(4 * spark.sparkContext.defaultParallelism, "lang", "word"), "langid-words")
    given = spark.sparkContext.broadcast((pieces, langs))
    start = 1.0 / (np.arange(len(pieces) + 2) + 100.0)
    table = normal(np.repeat(start[:, None], len(langs), 1), 0)
    for _ in range(passes):
        held = spark.sparkContext.broadcast(table)
        got = words.mapInArrow(_expect(given, held), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(table)
        counts[got["piece"], got["lang"]] = got["n"]
        table = normal(counts)
    return langs, table


def words_of(text: str | None) -> list[str]:
    """Lower-cased words between Unicode white space; none of a text without a letter."""
    return text.lower().split() if text and any(map(str.isalpha, text)) else []


def count_words(rows: DataFrame) -> DataFrame:
    """(lang, word, count) of rows (lang, t), pre-counted in each slice of texts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                by: dict[str, Counter] = {}
                for lang, text in zip(*(c.slice(a, b - a).to_pylist() for c in batch.columns)):
                    by.setdefault(lang, Counter()).update(words_of(text))
                for lang, n in by.items():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())], names=["lang", "word", "count"])

    return rows.mapInArrow(run, "lang string, word string, count long").groupBy("lang", "word").agg(F.sum("count").alias("count"))


def _expect(given, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, langs = given.value
        table, index, found = held.value, {x: k for k, x in enumerate(langs)}, _loaded(pieces)
        total = np.zeros_like(table)
        for batch in batches:
            lang = np.array([index[x] for x in batch.column(0).to_pylist()])
            words, n = batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
            for k in np.unique(lang):
                at = np.flatnonzero(lang == k)
                total[:, k] += expected_counts(found, table[:, k], [words[i] for i in at], n[at])
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[piece, lang])], names=["lang", "piece", "n"])

    return run


_LOADED: dict[int, Pieces] = {}


def _loaded(pieces: list[str]) -> Pieces:
    key = hash(tuple(pieces))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(pieces)
    return _LOADED[key]


class Identifier:
    def __init__(self, pieces: Pieces, langs: list[str], table: np.ndarray) -> None:
        self.pieces, self.langs, self.table = pieces, langs, table
        self._empty()

    def _empty(self) -> None:
        self.at: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.langs)))
        self.used = 0

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = list(map(words_of, texts))
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        every = set().union(*split)
        missing = [w for w in every if w not in self.at]
        if missing and (self.used > CACHE_CHARACTERS or len(self.at) * len(self.langs) > CACHE_CELLS):
            self._empty()
            missing = list(every)
        if missing:
            n = len(self.at)
            self.at.update(zip(missing, range(n, n + len(missing))))
            self.used += sum(map(len, missing))
            while len(self.scores) < len(self.at):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[n : len(self.at)] = word_scores(self.pieces, self.table, missing)
        langs, scores = [], []
        get = self.at.__getitem__
        for words in split:
            if not words:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.scores[np.fromiter(map(get, words), np.int64, len(words))].sum(0)
            best = int(np.argmax(total))
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


_IDENTIFIERS: dict[str, Identifier] = {}


def _identifier(name: str, pieces: list[str], langs: list[str], table: np.ndarray) -> Identifier:
    """One in each worker, so that its cache outlives a task."""
    if name not in _IDENTIFIERS:
        _IDENTIFIERS.clear()
        _IDENTIFIERS[name] = Identifier(_loaded(pieces), langs, table)
    return _IDENTIFIERS[name]


def identify(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None, passes: int = PASSES) -> DataFrame:
    """(id, held_out, lang_pred, score) of every text; rows that held_out doesn't mark are learned from."""
    pieces, held_out = read_pieces(path), F.coalesce(held_out, F.lit(False))
    langs, table = train(df.where(~held_out), text_col, lang_col, pieces, passes)
    model, name = df.sparkSession.sparkContext.broadcast((pieces, langs, table)), uuid.uuid4().hex
    kind = df.select(col(id_col)).schema[0].dataType.simpleString()

    def start() -> Callable:
        pieces, langs, table = model.value
        found = _identifier(name, pieces, langs, table)

        def run(ids, texts, held):
            lang, score = found.predict(texts)
            yield {"i": ids, "held_out": held, "lang_pred": lang, "score": score}

        return run

    rows = df.select(col(id_col).alias("i"), col(text_col).cast("string").alias("t"), held_out.alias("h"))
    out = map_columns(rows, f"i {kind}, held_out boolean, lang_pred string, score double", start, limit=SLICE)
    return out.selectExpr(f"i as `{id_col}`", "held_out", "lang_pred", "score")
