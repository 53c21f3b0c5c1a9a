"""LM scoring: a hidden Markov model over words, trained by Baum-Welch.

Words are counted over all training texts. At most OWN commonest words are classes of
their own, all others fall into BUCKETS classes by hash, and the end of a text is
one more class. Latent states emit classes; within a bucket, a word has the
probability (c + 1) / (t + v + 1) of its count c, the bucket's tokens t and
distinct words v, the last place being for words never seen. So the model's
tables are bounded whatever the vocabulary's size, and the model is a proper
distribution over texts.

Baum-Welch starts from a fit on INITIAL texts and then passes over all training
texts: each task adds up expected emissions and transitions, and these are summed
across partitions. Neither training nor scoring cuts a text: recursions run over each
whole text, in training by segments of bounded memory that hand their state on.

Counts of at most LOOKUP commonest words go to the workers; other words of a text
are joined with the table of counts by word. A frequent word is thus never a hot
key of that join, and no word's count is lost.

Defined cases: a null or empty text is the end token alone; words are runs
without ASCII white space, A-Z in lower case, as bytes of UTF-8; rows with a null id are scored
and, as their remainder is null, learned from; repeated rows are scored one by
one; with nothing to learn from, every base and model probability is defined by
zero counts; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.llm._arrow import col, slices
from treelake.llm._spark import most_frequent, written

STATES, OWN, BUCKETS = 8, 8192, 4096
LOOKUP = 1 << 17
INITIAL, INITIAL_STEPS, PASSES = 300, 12, 2
#: Cells (steps times sequences) side by side in training and in scoring.
CELLS, SCORE_CELLS = 1 << 19, 1 << 21
SLICE = 8 << 20
END = OWN + BUCKETS
CLASSES = END + 1


def words_of(text: bytes | None) -> list[bytes]:
    """Bytes know no letters and no white space but ASCII's: A-Z, and 0x20 and 0x09 to 0x0D, none of which is part of another character in UTF-8."""
    return text.lower().split() if text else []


def bucket(word: str | bytes) -> int:
    return OWN + zlib.crc32(word.encode() if isinstance(word, str) else word) % BUCKETS


def blocks(sequences: list[np.ndarray], cells: int, rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of like length side by side: (indices, lengths descending, (longest, n) padded with the end class).

    A grid has at most ``cells`` cells, or one sequence.
    """
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    k = 0
    while k < len(order):
        n = max(1, min(rows, cells // int(lengths[order[k]])))
        at = order[k : k + n]
        grid = np.full((int(lengths[at[0]]), len(at)), END, np.int32)
        for j, i in enumerate(at):
            grid[: lengths[i], j] = sequences[i]
        yield at, lengths[at], grid
        k += n


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move = start, move
        #: (classes, states): a class's row is what a step needs.
        self.emit = np.ascontiguousarray(emit.T)

    @classmethod
    def random(cls, totals: np.ndarray, seed: int = 0) -> Model:
        """Near to the classes' shares, with noise."""
        rng = np.random.default_rng(seed)
        emit = (totals + 0.1) * rng.gamma(2.0, 0.5, (STATES, len(totals)))
        move = np.full((STATES, STATES), 0.2 / STATES) + 0.8 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(1, keepdims=True))

    @classmethod
    def estimated(cls, counts: tuple[np.ndarray, np.ndarray, np.ndarray], totals: np.ndarray, strength: float = 200.0) -> Model:
        """From expected counts; emissions are drawn towards the classes' shares with a weight of ``strength`` tokens."""
        start, move, emit = counts
        share = (totals + 0.1) / (totals + 0.1).sum()
        emit = emit + strength * share
        move, start = move + 1.0, start + 1.0
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Scaled forward recursion over each whole sequence."""
        out = np.zeros(len(sequences))
        for at, lengths, grid in blocks(sequences, SCORE_CELLS):
            total = np.zeros(len(at))
            live = np.searchsorted(-lengths, -np.arange(len(grid)), "left")  # sequences longer than t
            a = self.start * self.emit[grid[0]]
            for t in range(len(grid)):
                if t:
                    n = live[t]
                    a = (a[:n] @ self.move) * self.emit[grid[t, :n]]
                c = a.sum(1)
                a /= c[:, None]
                total[: len(c)] += np.log10(c)
            out[at] = total
        return out

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, transitions and emissions (states, classes)."""
        starts, moves, emits = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))
        for _, lengths, grid in blocks(sequences, 16 * CELLS, 512):
            steps, n = grid.shape
            live = np.searchsorted(-lengths, -np.arange(steps), "left")
            # A long sequence is done in segments from the last to the first, each from its first forward value: memory is that of a segment.
            size = max(1, min(steps, CELLS // n))
            heads, a = [], None
            for s in range(0, steps - size, size):
                heads.append(a)
                a = self._forward(grid[s : s + size, : live[s]], live[s : s + size], a)[0][-1, : live[s + size - 1]]
            heads.append(a)
            b = np.ones((n, STATES))
            for k, s in reversed(list(enumerate(range(0, steps, size)))):
                part, alive = grid[s : s + size, : live[s]], live[s : s + size]  # what has ended by then is left out
                forward, scale, seen = self._forward(part, alive, heads[k])
                gamma = np.zeros_like(forward)
                for t in range(len(part) - 1, -1, -1):
                    m = alive[t]
                    gamma[t, :m] = forward[t, :m] * b[:m]
                    if s + t:
                        q = seen[t, :m] * b[:m] / scale[t, :m, None]
                        moves += (forward[t - 1, :m] if t else heads[k][:m]).T @ q
                        b[:m] = q @ self.move.T
                if not s:
                    starts += gamma[0].sum(0)
                flat = part.reshape(-1)
                for state in range(STATES):
                    emits[state] += np.bincount(flat, gamma[:, :, state].reshape(-1), CLASSES)
        return starts, moves * self.move, emits

    def _forward(self, grid: np.ndarray, live: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward values, their scales and the emissions of a grid's steps, after ``before`` or from the start."""
        steps, n = grid.shape
        forward, scale, seen = np.zeros((steps, n, STATES)), np.ones((steps, n)), self.emit[grid]
        for t in range(steps):
            m = live[t]
            a = (self.start if before is None else before[:m] @ self.move) * seen[t, :m]
            c = a.sum(1)
            before = a / c[:, None]
            forward[t, :m], scale[t, :m] = before, c
        return forward, scale, seen


def _bytes(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


def _strings(words: Iterable[bytes]) -> pa.Array:
    return pa.array(list(words), pa.binary()).view(pa.string())


def count_words(df: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts, pre-counted in each slice of texts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), SLICE):
                n = Counter()
                for t in _bytes(batch.column(0).slice(a, b - a)):
                    n.update(words_of(t))
                yield pa.RecordBatch.from_arrays([_strings(n.keys()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    return df.select(col(text_col).cast("string").alias("t")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", passes: int = PASSES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): base-10 logarithms of each whole text."""
    spark = df.sparkSession
    rows = df.select(col(id_col).alias("i"), col(text_col).cast("string").alias("t"), F.coalesce(held_out, F.lit(False)).alias("h"))
    train = rows.where(~F.col("h"))
    counts = written(count_words(train, "t"), "hmm-counts")
    texts = train.count()
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = (whole["n"] or 0) + texts, whole["v"] + (texts > 0)
    top = most_frequent(counts, LOOKUP).select(F.col("word").cast("binary").alias("word"), "n").toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    own = dict(zip(top["word"][:OWN], range(OWN)))
    by_bucket = counts.groupBy((F.crc32(F.col("word").cast("binary")) % BUCKETS).cast("int").alias("b")).agg(F.sum("n").alias("t"), F.count("*").alias("v")).toPandas()
    totals = np.zeros(CLASSES)
    rest = np.zeros((BUCKETS, 2))
    rest[by_bucket["b"]] = by_bucket[["t", "v"]]
    for word, n in zip(top["word"][:OWN], top["n"][:OWN]):
        totals[own[word]] = n
        rest[bucket(word) - OWN] -= n, 1
    totals[OWN:END], totals[END] = rest[:, 0], texts
    inside = np.zeros(CLASSES)  # log10 of a bucket's tokens + words + 1; nothing for words with a class of their own
    inside[OWN:END] = np.log10(rest.sum(1) + 1)

    lookup = spark.sparkContext.broadcast((top["word"].tolist(), np.log10(top["n"].to_numpy() + 1.0)))
    kind = df.select(col(id_col)).schema[0].dataType.simpleString()
    texts_seen = rows.mapInArrow(_encode(lookup), f"u long, i {kind}, h boolean, n_tokens long, n_known long, base double, extra double, classes binary, w array<string>, k array<int>")
    # Words are looked up once; training and scoring then read two bytes a token.
    encoded = written(texts_seen, "hmm-encoded")

    learn = encoded.where(~F.col("h"))
    # By hash about twice as many as are needed, so that no task sends all of INITIAL.
    hashed = learn.select("classes", F.xxhash64("i", "u").alias("h"), "u").where(F.col("h") / 2.0**64 + 0.5 <= 2 * INITIAL / max(texts, 1))
    some = hashed.orderBy("h", "u").limit(INITIAL).select("classes").toPandas()["classes"] if texts else []
    model = Model.random(totals)
    first = [unpack(x) for x in some]
    for _ in range(INITIAL_STEPS if first else 0):
        model = Model.estimated(model.expected(first), totals)
    for _ in range(passes if texts else 0):
        held = spark.sparkContext.broadcast(model)
        got = learn.select("classes").mapInArrow(_expect(held), "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
        flat = np.zeros(STATES * (1 + STATES + CLASSES))
        flat[got["k"]] = got["n"]
        a, b = STATES, STATES * (1 + STATES)
        model = Model.estimated((flat[:a], flat[a:b].reshape(STATES, STATES), flat[b:].reshape(STATES, CLASSES)), totals)

    # Of rarer words only (text, word, times) travels; the sums by text come back to one row each.
    rare = encoded.select("u", F.explode(F.arrays_zip("w", "k")).alias("r")).select("u", F.col("r.w").alias("w"), F.col("r.k").alias("k"))
    found = rare.join(counts.select(F.col("word").alias("w"), F.col("n").alias("c")), "w", "left")
    gain = found.groupBy(F.col("u").alias("g")).agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("gain"), F.sum(F.when(F.col("c").isNotNull(), F.col("k"))).alias("seen"))
    final = spark.sparkContext.broadcast((model, inside))
    out = encoded.select("u", "i", "h", "n_tokens", "n_known", "base", "extra", "classes").mapInArrow(_score(final), f"u long, i {kind}, h boolean, n_tokens long, n_known long, base double, model double")
    out = out.join(gain, F.col("u") == F.col("g"), "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    every, end = float(np.log10(tokens + distinct + 1.0)), float(np.log10(texts + 1.0))
    return out.select(
        F.col("i").alias(id_col),
        F.col("h").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0)) + F.lit(int(texts > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("gain") + F.lit(end) - F.col("n_tokens") * F.lit(every)).alias("base_score"),
        (F.col("model") + F.col("gain")).alias("score"),
    )


def unpack(classes: bytes) -> np.ndarray:
    return np.frombuffer(classes, np.uint16).astype(np.int32)


class Encoder:
    """Texts to classes, with what the lookup table knows of their words."""

    def __init__(self, words: list[bytes], logs: np.ndarray) -> None:
        self.code = dict(zip(words, range(len(words))))
        self.logs = np.append(logs, 0.0)  # the last is for rarer words
        own = len(words[:OWN])
        self.classes = np.array([*range(own), *(bucket(w) for w in words[own:]), 0], np.uint16)
        #: What a known word adds to the model's score beside its class.
        self.extra = np.where(np.arange(len(self.logs)) < own, 0.0, self.logs)

    def text(self, text: bytes | None) -> tuple[bytes, int, int, float, float, list[bytes], list[int]]:
        words = words_of(text)
        rest = len(self.logs) - 1
        codes = np.fromiter(map(self.code.get, words, repeat(rest)), np.int32, len(words))
        classes = np.empty(len(words) + 1, np.uint16)
        classes[:-1] = self.classes[codes]
        classes[-1] = END
        at = np.flatnonzero(codes == rest)
        rare: dict[bytes, int] = {}
        if len(at):
            some = [words[k] for k in at.tolist()]
            classes[at] = np.fromiter(map(zlib.crc32, some), np.uint32, len(some)) % BUCKETS + OWN
            rare = Counter(some)
        return classes.tobytes(), len(words) + 1, len(words) - len(at), float(self.logs[codes].sum()), float(self.extra[codes].sum()), list(rare), list(rare.values())


_ENCODER: dict[str, Encoder] = {}


def _encode(lookup):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODER:  # one in each worker, so that it outlives a task
            _ENCODER.clear()
            _ENCODER[name] = Encoder(*lookup.value)
        encoder, row = _ENCODER[name], TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE // 2):
                classes, tokens, known, base, extra, w, k = zip(*map(encoder.text, _bytes(batch.column(1).slice(a, b - a))))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in w])]).astype(np.int32)
                # A row's own key, as ids may be null or repeat; a repeated task gives the same keys.
                u = np.arange(row, row + b - a)
                row += b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(u, pa.int64()),
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array(tokens, pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(extra, pa.float64()),
                        pa.array(classes, pa.binary()),
                        pa.ListArray.from_arrays(offsets, _strings(chain.from_iterable(w))),
                        pa.ListArray.from_arrays(offsets, pa.array([x for y in k for x in y], pa.int32())),
                    ],
                    names=["u", "i", "h", "n_tokens", "n_known", "base", "extra", "classes", "w", "k"],
                )

    return run


def _ranges(sizes: list[int], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many tokens."""
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _expect(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        total = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))]
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for a, b in _ranges([len(x) // 2 for x in rows], 1 << 20):
                for x, y in zip(total, model.expected([unpack(r) for r in rows[a:b]])):
                    x += y
        flat = np.concatenate([x.reshape(-1) for x in total])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at])], names=["k", "n"])

    return run


def _score(final):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, inside = final.value
        for batch in batches:
            rows, extra = batch.column(7).to_pylist(), batch.column(6).to_numpy()
            for a, b in _ranges([len(x) // 2 for x in rows]):
                sequences = [unpack(r) for r in rows[a:b]]
                scores = model.log10(sequences) - np.array([inside[s].sum() for s in sequences]) + extra[a:b]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(6)), pa.array(scores)], names=["u", "i", "h", "n_tokens", "n_known", "base", "model"])

    return run
